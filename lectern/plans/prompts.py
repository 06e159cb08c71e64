"""Prompts of the model calls, by what is asked: ``{{name}}`` is put in from columns."""

from __future__ import annotations

from ..schemas import SCOPES

GENERATE_SYSTEM = "You write quiz questions from lecture material. Answer with JSON only."
FILTER_SYSTEM = "You judge quiz questions. For each failure mode give a severity from 0 to 1. Answer with JSON only."
SELECT_SYSTEM = "You select quiz questions. Answer with JSON only."

_QUESTION = (
    'Answer with {"questions": [{"type", "title", "questionText", "options": [{"text", "correct"}], "explanation"%s}]}. '
    "Options are complete and of like length, none repeats or holds another, and none says all or none of the above."
)
_ASK = "Write {{count}} question(s) of the types {{types}} at difficulty {{difficulty}}.\n"
_REST = "Instructions: {{instructions}}\n{{grounding}}"

#: A quiz on a topic, a quiz on competencies (each question names its own), and a batch for one cell of a pool.
GENERATE = {
    "topic": f"{_ASK}Topic: {{{{topic}}}}\n{_QUESTION % ''}\n{_REST}",
    "competencies": f"{_ASK}Competencies, of which each question tests one:\n{{{{topic}}}}\n"
    + (_QUESTION % ', "competency"')
    + ' "competency" is the one it tests, in the words above.\n'
    + _REST,
    "cell": f"{_ASK}Cell: {{{{topic}}}}\nThe questions are for a pool that later quizzes select from: each stands alone, and no two ask the same.\n{_QUESTION % ''}\n{_REST}",
}

#: What each failure mode means.
MODES = {
    "FACTUAL_ERROR": "the question, an option or the explanation says something that is wrong",
    "AMBIGUOUS_CORRECT_ANSWER": "more options than marked can be defended, or a marked one can't",
    "OFF_TOPIC": "it tests something that the material doesn't teach",
    "NEAR_DUPLICATE": "options say the same in other words",
    "ILL_FORMED_DISTRACTORS": "wrong options give themselves away by form, length or absurdity",
    "COMPETENCY_MISMATCH": "it tests another competency than the one asked for",
    "DIFFICULTY_MISMATCH": "it is much easier or harder than asked for",
    "INSTRUCTION_VIOLATION": "it does what the instructions rule out, or leaves out what they ask for",
}

_OF_SCOPE = {
    "GENERAL": "Judge the question as it stands, whatever it was asked for.\n",
    "REQUEST_FIT": "Judge only whether the question fits its request; its quality was judged before.\nRequest: {{request}}\n",
    "COMBINED": "Judge the question as it stands, and whether it fits its request.\nRequest: {{request}}\n",
}


def judging(scope: str) -> str:
    """The prompt of a scope: its modes, what they mean, and what is looked at."""
    means = "\n".join(f"- {m}: {MODES[m]}" for m in SCOPES[scope])
    return (
        f"Judge the modes {{{{modes}}}}.\n{_OF_SCOPE[scope]}{means}\n"
        'Answer with {"modes": [{"mode", "severity", "triggered", "justification"}], "rationale"}, one entry for each mode.\n'
        "Title: {{title}}\nQuestion: {{question}}\n{{options}}\n{{grounding}}"
    )


SELECT = (
    "Select {{count}} of these candidates by id.\nPrefer sound ones that cover different parts of the request and don't repeat each other.\n"
    'Answer with {"chosen": [ids, best first], "rejected": [{"id", "reason"}], "rationale"}.\n{{candidates}}'
)
