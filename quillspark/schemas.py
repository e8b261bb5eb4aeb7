"""Schemas of the stored tables, as DDL."""

_FROM = "provenance_source STRING, provenance_model STRING, provenance_prompt_version STRING, provenance_timestamp TIMESTAMP, provenance_response_id STRING, created_at TIMESTAMP"
_CASE = "court STRING, division STRING, year INT, number INT"

TABLES: dict[str, str] = {
    "legislation": f"id STRING, uri STRING, title STRING, description STRING, text STRING, enactment_date DATE, valid_date DATE, modified_date DATE, publisher STRING, category STRING, type STRING, year INT, number INT, status STRING, extent ARRAY<STRING>, number_of_provisions INT, {_FROM}",
    "legislation_section": f"id STRING, uri STRING, legislation_id STRING, title STRING, text STRING, extent ARRAY<STRING>, provision_type STRING, number INT, legislation_type STRING, legislation_year INT, legislation_number INT, {_FROM}",
    "caselaw": f"id STRING, {_CASE}, name STRING, cite_as STRING, date DATE, date_of STRING, header STRING, text STRING, caselaw_references ARRAY<STRING>, legislation_references ARRAY<STRING>, created_at TIMESTAMP",
    "caselaw_section": f"id STRING, caselaw_id STRING, {_CASE}, cite_as STRING, route ARRAY<STRING>, `order` INT, text STRING, created_at TIMESTAMP",
    "caselaw_summary": f"id STRING, caselaw_id STRING, {_CASE}, name STRING, cite_as STRING, date DATE, text STRING, ai_model STRING, ai_timestamp TIMESTAMP, source_text_length INT, source_text_truncated BOOLEAN, created_at TIMESTAMP",
    "explanatory_note": "id STRING, legislation_id STRING, note_type STRING, route ARRAY<STRING>, section_type STRING, section_number INT, `order` INT, text STRING, created_at TIMESTAMP",
    "amendment": "changed_legislation STRING, changed_year INT, changed_number STRING, changed_url STRING, changed_provision STRING, changed_provision_url STRING, affecting_legislation STRING, affecting_year INT, affecting_number STRING, affecting_url STRING, affecting_provision STRING, affecting_provision_url STRING, type_of_effect STRING, id STRING, ai_explanation STRING, ai_explanation_model STRING, ai_explanation_timestamp TIMESTAMP",
    "vectors": "id STRING, dense ARRAY<FLOAT>, sparse_term STRING, sparse_weight DOUBLE",
    "tracking": "url STRING, status STRING, uuid STRING, error STRING, run_id STRING, doc_type STRING, year INT, type_value STRING, doc_date STRING, timestamp STRING",
    "pdf_result": "extracted_data STRING, success BOOLEAN, error STRING, pdf_source STRING, legislation_type STRING, identifier STRING, provenance STRUCT<source:STRING, model:STRING, prompt_version:STRING, timestamp:TIMESTAMP, processing_time_seconds:DOUBLE, input_tokens:INT, output_tokens:INT, cached_tokens:INT, response_id:STRING>",
}
