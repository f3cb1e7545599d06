"""Explicit schemas of the stored entities; nothing is inferred."""

from pyspark.sql import types as T


def _fields(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)


PROJECT = _fields("id string, title string, target_role string, department string, status string, created_at timestamp, updated_at timestamp, deleted_at timestamp")
DOCUMENT = _fields("id string, project_id string, document_type string, filename string, file_hash string, file_size bigint, stage string, status string, created_at timestamp, updated_at timestamp, deleted_at timestamp")
PARSED_DOCUMENT = _fields("document_id string, raw_text string, normalized_text string, page_count int, word_count int, character_count int, parser_engine string, parsing_duration_ms double")
EDUCATION = _fields("degree string, institution string, year string, field_of_study string")
EXPERIENCE = _fields("company string, title string, designation string, employment_type string, start_date string, end_date string, duration string, is_current boolean, description string, responsibilities array<string>, location string")
PROJECT_ITEM = _fields("name string, description string, technologies array<string>, deliverables array<string>, highlights array<string>, summary string, responsibilities array<string>, outcomes array<string>, details string")
EXPERIENCE_REQUIREMENT = _fields("minimum_months int, maximum_months int, display_value string")
CHANGE = _fields("field string, source string, canonical string, rule string")
REQUIREMENT = _fields("document_id string, requirement_id string, kind string, text string")
EVIDENCE = _fields("document_id string, evidence_id string, kind string, text string")
VERDICT = _fields("document_id string, requirement_id string, status string, method string, evidence_ids array<string>, confidence double, coverage double")
CANDIDATE_SCORE = _fields("id string, project_id string, document_id string, skills_score decimal(5,2), experience_score decimal(5,2), final_score decimal(5,2), confidence decimal(5,2), recommendation string, is_knocked_out boolean, created_at timestamp")
CANDIDATE_RANKING = _fields("project_id string, document_id string, candidate_score_id string, rank_position int, percentile decimal(5,2), previous_rank int, rank_change int")
EXTRACTED_RESUME = T.StructType(
    _fields("document_id string, name string, email string, phone string, designation string, location string, skills array<string>, certifications array<string>, companies array<string>, languages array<string>, confidence_scores map<string,double>").fields
    + [T.StructField("education", T.ArrayType(EDUCATION)), T.StructField("experience", T.ArrayType(EXPERIENCE)), T.StructField("projects", T.ArrayType(PROJECT_ITEM))]
)
