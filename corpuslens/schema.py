"""Record types, enumerations and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POLICIES = ("read-only", "draft-write", "full-write")
CHUNK_KINDS = ("paragraph", "page", "sheet", "slide", "row_group", "section", "table", "other")

WORKSPACES = (
    "id string, name string, root_path string, policy string, status string, exclude_globs array<string>, include_extensions array<string>, "
    "max_file_size_mb int, enable_ocr boolean, enable_vector_search boolean, pii_warning boolean, created_at timestamp, "
    "last_indexed_at timestamp, document_count int, error string"
)
DOCUMENTS = (
    "id string, workspace_id string, path string, name string, kind string, size_bytes bigint, sha256 string, mtime timestamp, "
    "indexed_at timestamp, page_count int, sheet_count int, slide_count int, has_extracted_text boolean, extraction_method string, "
    "extraction_error string, language_hints array<string>, pii_flagged boolean"
)
CHUNKS = (
    "id string, document_id string, workspace_id string, kind string, ordinal int, page_number int, sheet_name string, cell_range string, "
    "slide_number int, section_heading string, text string, char_count int, confidence double, extraction_method string"
)
FIELDS = (
    "document_id string, chunk_id string, key string, value string, value_type string, confidence double, page_number int, "
    "cell_range string, extractor string"
)
ENTITIES = "document_id string, chunk_id string, text string, kind string, confidence double"
VECTORS = "chunk_id string, workspace_id string, document_id string, embedding array<float>, error string, cell int, away double"
CENTRES = "cell int, centre array<double>"
GRAMS = "gram string, low string, document_id string"
POSTINGS = "chunk_id string, workspace_id string, document_id string, term string, tf long"
LENGTHS = "chunk_id string, workspace_id string, document_id string, length int"
AUDIT = (
    "id string, timestamp timestamp, actor string, operation string, user_request string, tool string, referenced_files array<string>, "
    "output_files array<string>, risk string, user_approved boolean, error string, extra map<string,string>"
)
TABLES = {
    "workspaces": WORKSPACES, "documents": DOCUMENTS, "chunks": CHUNKS, "fields": FIELDS, "entities": ENTITIES, "vectors": VECTORS, "audit_log": AUDIT,
    "postings": POSTINGS, "lengths": LENGTHS, "grams": GRAMS, "centres": CENTRES,
}

#: The kind of a document by the extension of its file.
KIND_BY_EXTENSION = {
    ".pdf": "pdf", ".docx": "docx", ".xlsx": "xlsx", ".xlsm": "xlsx", ".pptx": "pptx", ".csv": "csv", ".tsv": "tsv", ".txt": "txt",
    ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".json": "json", ".xml": "xml", ".eml": "email",
    ".png": "image", ".jpg": "image", ".jpeg": "image", ".webp": "image", ".tiff": "image", ".tif": "image", ".heic": "image",
}


def document_id(workspace_id: Column, path: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha1(F.concat(workspace_id, F.lit(":"), path)), 1, 16))


def chunk_id(document: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("chk_"), F.substring(document, 5, 2**31 - 1), F.lit("_"), F.lpad(ordinal.cast("string"), 5, "0"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def kind_of(path: Column) -> Column:
    """The kind by extension, in any case; null for what is not indexed."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    pairs = [F.lit(x) for pair in KIND_BY_EXTENSION.items() for x in pair]
    return F.create_map(*pairs)[extension]


def locator(page: Column, sheet: Column, cells: Column, slide: Column) -> Column:
    """``p.3 sheet=Q1 cells=A1:B9 slide=2``, of what is there."""
    part = lambda prefix, c: F.when(c.isNotNull(), F.concat(F.lit(prefix), c.cast("string")))
    return F.concat_ws(" ", part("p.", page), part("sheet=", sheet), part("cells=", cells), part("slide=", slide))
