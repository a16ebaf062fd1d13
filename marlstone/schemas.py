"""Record schemas, as DDL."""

DOC_REGISTRY = "title STRING, url STRING, parent STRING, output_file STRING, toc_entries INT, char_count INT, scraped_at STRING"
REFERENCE_LINKS = (
    "url STRING, link_text STRING, title STRING, what_it_contains STRING, when_to_refer STRING, category STRING, access STRING, found_in_doc STRING, section STRING, breadcrumb STRING, "
    "source_url STRING, surrounding_text STRING, is_scraped BOOLEAN, also_found_in ARRAY<STRING>"
)
RESTRICTED_LINKS = "url STRING, skip_reason STRING, found_in_doc STRING, section STRING, breadcrumb STRING, source_url STRING, surrounding_text STRING, access STRING, note STRING, category STRING"
IMAGE_METADATA = (
    "filename STRING, filepath STRING, doc_title STRING, section STRING, breadcrumb STRING, source_url STRING, surrounding_before STRING, surrounding_after STRING, file_size_kb DOUBLE, image_hash STRING, "
    "image_content STRING, is_decorative BOOLEAN, chunk_type STRING, needs_ocr BOOLEAN, scan_method STRING, scan_error STRING"
)
CHUNK_BASE = (
    "chunk_id STRING, chunk_type STRING, content STRING, embed_text STRING, heading STRING, heading_level INT, doc_title STRING, section STRING, breadcrumb STRING, source_url STRING, parent_doc STRING, "
    "`references` ARRAY<STRING>, hyde_questions ARRAY<STRING>, created_at STRING, version STRING, token_count INT"
)
EVAL_QUESTIONS = "id STRING, question STRING, expected_keywords ARRAY<STRING>, expected_source STRING, chunk_type STRING, topic STRING, history ARRAY<STRUCT<role: STRING, content: STRING>>"
EVENT_LINES = "request_id STRING, seq INT, line STRING"
CHUNK_TYPES = ["text", "table", "image", "reference_link", "restricted_doc", "section_index"]
