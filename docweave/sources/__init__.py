"""Sources and sinks: tables, JSON documents, media, event lines, prompts, upserts."""
