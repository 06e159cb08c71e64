"""Types of the stored tables and ordered value sets.

Nested values are structs rather than JSON text; JSON is parsed at the boundary only.
"""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, INT, DOUBLE, BOOLEAN, TIMESTAMP = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


# Ordered value sets.
SOURCE_ROLES = ("LECTURE_DECK", "TUTORIAL", "CENTRAL_EXERCISE", "SOLUTION", "OTHER")
QUESTION_TYPES = ("single-choice", "multiple-choice", "true-false")
FAILURE_MODES = ("FACTUAL_ERROR", "AMBIGUOUS_CORRECT_ANSWER", "OFF_TOPIC", "NEAR_DUPLICATE", "ILL_FORMED_DISTRACTORS", "COMPETENCY_MISMATCH", "DIFFICULTY_MISMATCH", "INSTRUCTION_VIOLATION")
DIFFICULTIES = {"easy": 20, "medium": 50, "hard": 80}
LANGUAGES = ("en", "de")
ITEM_STATES = ("PENDING", "GENERATING", "GENERATED", "FILTERING", "FILTERED", "FAILED_GENERATION", "FAILED_FILTER")
OPEN_STATES = ITEM_STATES[:4]
TAXONOMIES = ("REMEMBER", "UNDERSTAND", "APPLY", "ANALYZE", "EVALUATE", "CREATE")
RELATIONS = ("ASSUMES", "EXTENDS", "MATCHES")
CALL_KINDS = {"AUTH": False, "BAD_REQUEST": False, "RATE_LIMIT": True, "TIMEOUT": True, "TRANSPORT": True}
TRANSIENT_FAILURES = ("TIMEOUT", "TRANSPORT", "RATE_LIMIT")
DEFECTS = ("UNMAPPABLE", "TYPE_NOT_REQUESTED", "BLANK_TEXT", "DANGLING_REFERENCE", "OPTION_COUNT", "BLANK_OPTION", "DUPLICATE_OPTIONS", "BANNED_CONSTRUCTION", "CONTAINED_OPTION", "CORRECT_COUNT", "CONSPICUOUS_LENGTH")
SCOPES = {"GENERAL": FAILURE_MODES[:5], "REQUEST_FIT": FAILURE_MODES[5:], "COMBINED": FAILURE_MODES}


def thresholds(step: float = 0.05) -> list[float]:
    """Sweep thresholds from 0 to 1, accumulated step by step: the rounding of each sum is part of the semantics."""
    out, t = [], 0.0
    while t <= 1.0001:
        out.append(t)
        t += step
    return out


PAGE = struct(document_id=STRING, lecture=STRING, unit=STRING, page_number=INT, text=STRING)
CHUNK = struct(chunk_id=STRING, document_id=STRING, lecture=STRING, unit=STRING, first_page=INT, last_page=INT, role=STRING, text=STRING)
OPTION = struct(text=STRING, correct=BOOLEAN, hint=STRING, explanation=STRING)
ITEM_BODY = struct(type=STRING, title=STRING, question_text=STRING, options=T.ArrayType(OPTION), hint=STRING, explanation=STRING)
CALL = struct(
    request_id=STRING, stage=STRING, model=STRING, prompt_tokens=LONG, completion_tokens=LONG, wall_clock_ms=LONG, retry_count=INT, outcome=STRING, error_message=STRING,
    failure_category=STRING, cache_read_tokens=LONG, cache_write_tokens=LONG, provider_cost=DOUBLE, provider_cost_currency=STRING,
)
MODE_VERDICT = struct(severity=DOUBLE, triggered=BOOLEAN, justification=STRING)
DECISION = struct(accepted=BOOLEAN, aggregate_score=DOUBLE, mean_severity=DOUBLE, mode_verdicts=T.MapType(STRING, MODE_VERDICT), filter_model=STRING, rationale=STRING)
COMPOSITION = struct(counts_by_role=T.MapType(STRING, INT), solution_fraction=DOUBLE, unknown_roles=INT)
PROVENANCE = struct(
    generator_model=STRING, filter_model=STRING, topic=STRING, grounding_chunk_ids=T.ArrayType(STRING), prompt_text=STRING, requested_difficulty=INT,
    damage_suspected=BOOLEAN, grounding_composition=COMPOSITION, generated_at=TIMESTAMP,
)
RUN = struct(run_id=STRING, configuration_id=STRING, manifest=STRING, created_at=TIMESTAMP)
ITEM_KEY = ("run_id", "configuration_id", "topic_key", "item_index")
ITEM = struct(
    item_id=LONG, run_id=STRING, configuration_id=STRING, topic_key=STRING, item_index=INT, state=STRING, generation_attempts=INT, filter_attempts=INT, item=ITEM_BODY,
    provenance=PROVENANCE, decision=DECISION, calls=T.ArrayType(CALL), failure=STRING, updated_at=TIMESTAMP, difficulty=INT, course_key=STRING, competency_key=STRING,
    language=STRING, question_type=STRING, difficulty_band=STRING, section_index=INT, generator_model=STRING,
)
ATTEMPT = struct(item_id=LONG, chosen_option=STRING, correct=BOOLEAN, answered_at=TIMESTAMP)
VERDICT = struct(item_id=LONG, judge_model=STRING, scope=STRING, accepted=BOOLEAN, decision=DECISION, created_at=TIMESTAMP, calls=T.ArrayType(CALL))
QUESTION = struct(item=ITEM_BODY, decision=DECISION, competency_key=STRING)
QUIZ = struct(
    quiz_id=STRING, run_id=STRING, configuration_id=STRING, request_key=STRING, repetition=INT, course_key=STRING, complete=BOOLEAN, questions=T.ArrayType(QUESTION),
    rejected=T.ArrayType(QUESTION), calls=T.ArrayType(CALL), candidate_count=INT, created_at=TIMESTAMP,
)
DOCUMENT = struct(course_key=STRING, document=STRING, content_hash=STRING, updated_at=TIMESTAMP)
RUN_RECORD = struct(schema_version=INT, run_id=STRING, configuration_id=STRING, item=ITEM_BODY, provenance=PROVENANCE, filter_decision=DECISION, calls=T.ArrayType(CALL))
SNIPPET = struct(source=STRING, unit=STRING, page_range=STRING, text=STRING, chunk_id=STRING, role=STRING, score=DOUBLE)
TABLES = {"run": RUN, "item": ITEM, "attempt": ATTEMPT, "verdict": VERDICT, "quiz": QUIZ, "document": DOCUMENT}
