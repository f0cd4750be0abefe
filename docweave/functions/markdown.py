"""Markdown of elements and sections, and the text of prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed texts of the prompt.
SYSTEM_PROMPT = "Tu es un assistant utile. Réponds en te basant uniquement sur les sources fournies."
PROMPT_HEAD = "Voici les sources disponibles pour répondre à la question de l'utilisateur.\nChaque source est une section de document avec son contexte hiérarchique.\n\n"
PROMPT_TAIL = "\n\nRéponds en te basant uniquement sur les sources ci-dessus.\nChaque élément des sources est suivi de son identifiant [src:ID] : reprends ces\nidentifiants tels quels pour citer tes affirmations (n'en invente jamais)."
CONTEXT, TABLE = "[Contexte] ", "[Tableau] "


def element_parts(label: Column, text: Column, node_id: Column, media_url: Column) -> Column:
    """The markdown parts of one element, by its label; parts that are blank are left to the caller."""
    label, text = F.lower(F.coalesce(label, F.lit(""))), F.coalesce(text, F.lit(""))
    src = F.concat(F.lit("[src:"), node_id, F.lit("]"))
    img = F.when(F.coalesce(media_url, F.lit("")) != "", F.concat(F.lit("[img:"), node_id, F.lit("]")))
    one = lambda *parts: F.array(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    none = F.array().cast("array<string>")
    return F.array_compact(
        F.when(label.isin("paragraph", "text", "listitem"), one(text, " ", src))
        .when(label == "table", F.concat(one(TABLE, text, " ", src), F.array(img)))
        .when(label == "picture", F.array(img))
        .when(label == "caption", one("_", text, "_ ", src))
        .when(label.isin("code", "formula"), one("```\n", text, "\n```\n", src))
        .when(text != "", one(text, " ", src))
        .otherwise(none)
    )


def trail(breadcrumbs: Column) -> Column:
    """Texts of the breadcrumbs, cut to 60 characters, or their labels."""
    return F.array_join(F.transform(breadcrumbs, lambda b: F.when(F.coalesce(b["text"], F.lit("")) != "", F.substring(b["text"], 1, 60)).otherwise(b["label"])), " > ")


def section_markdown(breadcrumbs: Column, elements: Column, title: Column) -> Column:
    """Context line, title and elements, a blank line apart; empty if there are neither breadcrumbs nor elements."""
    head = F.when(F.size(breadcrumbs) > 0, F.concat(F.lit(CONTEXT), trail(breadcrumbs), F.lit("\n")))
    name = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("## "), title, F.lit("\n")))
    parts = F.flatten(F.transform(elements, lambda e: element_parts(e["label"], e["text"], e["node_id"], e["minio_url"])))
    every = F.filter(F.concat(F.array_compact(F.array(head, name)), parts), lambda p: p.rlike(r"\S"))
    return F.when((F.size(breadcrumbs) == 0) & (F.size(elements) == 0), F.lit("")).otherwise(F.array_join(every, "\n\n"))


def with_orphan(markdown: Column, own_text: Column, is_header: Column) -> Column:
    """An element without a section is its own context."""
    return F.when(is_header | (F.coalesce(own_text, F.lit("")) == ""), markdown).when(markdown == "", own_text).otherwise(F.concat_ws("\n\n", markdown, own_text))


def prompt(question: Column, contexts: Column) -> Column:
    """The user message: numbered sources with id, path and markdown, then the question. contexts are (element_id, path, markdown) in order."""
    source = lambda c, i: F.concat(
        F.lit("\n---\nSource "), (i + 1).cast("string"), F.lit(" — "), c["element_id"], F.lit("\n"),
        F.when(F.coalesce(c["path"], F.lit("")) != "", F.concat(F.lit("Chemin : "), c["path"])).otherwise(F.lit("")),
        F.lit("\n\n"), c["markdown"], F.lit("\n---\n"),
    )
    return F.concat(F.lit(PROMPT_HEAD), F.array_join(F.transform(contexts, source), ""), F.lit("\n\nQuestion de l'utilisateur : "), question, F.lit(PROMPT_TAIL))
