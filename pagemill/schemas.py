"""Schemas and fixed vocabularies."""

NODE = "struct<kind: string, level: int, text: string, language: string, line_start: int, line_end: int, page_number: int, content_role: string>"
NODES = f"array<{NODE}>"
CHUNK = "struct<heading_path: array<string>, text: string, content_type: string, content_role: string, source_line_start: int, source_line_end: int, page_start: int, page_end: int>"

ROLES = ("body", "table_of_contents", "header_footer", "footnote", "front_matter")
INDEXED_ROLES = ("body", "front_matter")
MEDIA_EXTENSIONS = {"application/pdf": (".pdf",), "text/plain": (".txt",), "text/markdown": (".md", ".markdown")}
SEED_KNOWLEDGE_BASE = ("c87d83a0-eac5-4a2c-9b7d-31fbdce39f51", "ACTIVE")
FAILURE_MESSAGE = "Document processing failed"


def node(kind: str, text: str, level=None, language=None, line_start=None, line_end=None, page_number=None, content_role="body") -> dict:
    return {"kind": kind, "level": level, "text": text, "language": language, "line_start": line_start, "line_end": line_end, "page_number": page_number, "content_role": content_role}
