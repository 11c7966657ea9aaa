"""Declared schemas: ids stay text, nothing is inferred."""

from pyspark.sql.types import (
    ArrayType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType,
    TimestampType,
)

_TYPES = {
    "string": StringType(), "int": IntegerType(), "double": DoubleType(),
    "timestamp": TimestampType(), "array<string>": ArrayType(StringType()),
    "array<float>": ArrayType(FloatType()),
}


def _schema(columns: str) -> StructType:
    """Schema from "name type, ..." without needing a running session."""
    pairs = (c.split() for c in columns.split(","))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


QA_BINARY = _schema(
    "record_id string, source_dataset string, question string, knowledge string, answer string, "
    "difficulty_level string, is_hallucinated int, hallucination_category string")
QA_COMMON = _schema(
    "dataset_name string, record_id string, question string, knowledge string, answer string, "
    "is_hallucinated int, case_type string, source_split string, source_file string")
BENCHMARK = _schema("id string, label string, prompt string, response string")
GROUP_SPLIT = _schema(
    "id string, label string, prompt string, dataset_name string, source_record_id string, "
    "source_split string, source_file string, case_type string, question_group_id string")
EVIDENCE = _schema(
    "record_id string, split string, research_question string, evidence string, "
    "embedding array<float>")
PREDICTIONS = _schema(
    "record_id string, is_hallucinated int, predicted_label int, hallucination_probability double, "
    "question string, knowledge string, answer string, difficulty_level string, "
    "hallucination_category string")
CASE_LOG = _schema(
    "logged_at timestamp, case_id string, best_similarity double, safety_label string, "
    "evidence_label string, candidate_stance string, consistency_label string, "
    "routing_action string, routing_reasons array<string>, disposition_label string, "
    "disposition_kind string")
OBJECT_MAP = "map<string, struct<QUESTION: string, CONTEXTS: array<string>, final_decision: string>>"
