"""Explicit schemas of the tables that the engine reads and writes."""

from __future__ import annotations

CHUNK = "chunk_id string, element_id string, graph_node_id string, document string, filename string, label string, page_no int, minio_url string, page_position int, ref_position int, distance double, rerank_score double, embedding array<float>"
NODE = "node_id string, tag string, label string, text string, minio_url string, page_no int, filename string"
PARENT_OF = "src string, dst string, sequence int"
LINKED_TO = "src string, dst string, relation string"
MESSAGE = "thread_id string, turn long, role string, content string"
QUESTION = "question_id string, question string, embedding array<float>"
SELECTION = "question_id string, element_id string, ord int"
RESPONSE = "question_id string, response string"
EVENT = "thread_id string, seq long, kind string, payload string"
BBOX = "struct<l:double,t:double,r:double,b:double>"
ELEMENT = f"struct<id:string,label:string,text:string,page_no:int,`order`:int,page_position:int,ref_position:int,bbox:{BBOX},minio_url:string,content:string,reference_id:string,type:string>"
EXTRACTED = f"metadata struct<filename:string,type_file:string,total_pages:int>, elements array<{ELEMENT}>"
GOLDEN = "question string, expected_answer string, chunk_ids array<string>"
RESPONSE_LINE = "message struct<content:string>, done boolean, error string"
EVENT_LINE = "token string, reset boolean, done boolean, answer string"
