"""Plans written by an injected model: prompts, correction after failures and objections, a check of the answer.

A writer takes a prompt and returns the steps of the plan algebra, as JSON text or as a list; a checker takes a
prompt and returns a verdict. Either may have a method ``bind(temperature=...)``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates
from . import algebra

# Budgets in characters, the verdict's prefix, categories that a prompt lists, temperatures.
MAX_PROMPT, MAX_ERROR, MIN_PLAN, MIN_ERROR, MAX_ISSUE, MAX_PREVIEW = 10_500, 400, 80, 40, 300, 1200
OBJECTION = "SORUN"
MAX_VALUES, SAMPLE_ROWS = 15, 2
STEP_TEMPERATURE, MAX_TEMPERATURE = 0.2, 0.7
CUT_MARK, CUT_NOTE = "\n...[kirpildi]", "(eski denemeler prompt boyutu icin kirpildi)\n"


def describe(df: DataFrame) -> str:
    """What a writer has to know of a table: rows, columns, types, two rows, and all values of columns with few."""
    texts = [c for c, t in df.dtypes if t == "string"]
    sample = [json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str) for r in df.limit(SAMPLE_ROWS).collect()]
    values = aggregates.few_values(df, texts, MAX_VALUES) if texts else {}
    lines = [f"Rows: {df.count()}", "Columns: " + ", ".join(f"{c} ({t})" for c, t in df.dtypes), "First rows: " + "; ".join(sample)]
    lines += [f"All values of {c}: {', '.join(v)}" for c, v in values.items()]
    return "\n".join(lines)


def plan_prompt(question: str, description: str) -> str:
    """A question over a described table, with the rules of the plan algebra."""
    return "\n".join([
        "Write a plan that answers the question over the table, as a JSON list of steps and nothing else.",
        description,
        'Steps: {"step": "filter", "where": P}, {"step": "select", "columns": [..]}, {"step": "with", "name": N, "expr": E}, {"step": "group", "keys": [..], "aggs": {name: [function, column]}},',
        '{"step": "value_counts", "column": C}, {"step": "explode", "column": C}, {"step": "sort", "by": ["-column", ..], "limit": n}, {"step": "ratio", "where": P}, {"step": "signed_sum", "amount": C, "positive": P},',
        '{"step": "scenario_delta", "amount": C, "narrow": P, "wide": P}.',
        f'P: {{"and"|"or": [P, ..]}}, {{"not": P}}, {{"col": C, "op": O, "value": V}}; O: {", ".join(algebra.COMPARISONS)}, startswith, contains, endswith, isin, isnull, notnull.',
        f"Functions: {', '.join(algebra.AGGREGATES)}. Use the columns exactly as they are named. Compute groups that are compared separately.",
        f"Question: {question}",
        "Plan:",
    ])


def _entry(n: int, plan: str, error: str) -> str:
    return f"--- Attempt {n} ---\nPlan:\n{plan}\nERROR: {error}\n"


def _short(error: str) -> str:
    return error if len(error) <= MAX_ERROR else error[:MAX_ERROR] + "..."


def _newest_first(history: list[tuple[str, str]], budget: int) -> tuple[list[str], bool]:
    """(entries that fit, oldest first; whether all are there whole). The entry at which the budget ends keeps its
    error, and the head of its plan if there is room for some of it."""
    kept: list[str] = []
    for n in range(len(history), 0, -1):
        plan, error = history[n - 1][0], _short(history[n - 1][1])
        room = budget - bool(kept)  # the line end between two entries
        if len(_entry(n, plan, error)) <= room:
            kept.insert(0, _entry(n, plan, error))
            budget = room - len(kept[0])
            continue
        head = room - len(_entry(n, "", error))
        if head >= MIN_PLAN:
            kept.insert(0, _entry(n, plan[: head - len(CUT_MARK)] + CUT_MARK, error))
        elif (left := room - len(_entry(n, "(kirpildi)", ""))) >= MIN_ERROR:
            kept.insert(0, _entry(n, "(kirpildi)", error if len(error) <= left else error[: left - 3] + "..."))
        return kept, False
    return kept, True


def fitted(history: list[tuple[str, str]], budget: int) -> str:
    """Failed attempts (plan, error) within a budget; a note says so where something is cut."""
    kept, whole = _newest_first(history, budget)
    return "\n".join(kept) if whole else CUT_NOTE + "\n".join(_newest_first(history, max(0, budget - len(CUT_NOTE)))[0])


def correction_prompt(question: str, description: str, history: list[tuple[str, str]], repeated: bool = False, limit: int = MAX_PROMPT) -> str:
    """The plan prompt, what failed so far, and the task at the end; history is cut so that the limit holds."""
    again = "The last plan was the same as an earlier one and failed the same way. Write a DIFFERENT plan, in smaller steps.\n" if repeated else ""
    parts = (
        plan_prompt(question, description) + "\n\n=== Attempts that failed; do not repeat them ===\n",
        f"\n=== Correction ===\nFind the cause of the errors above and write a plan that runs.\n{again}Copy column names from the list. Use the simplest steps that do.\nQuestion: {question}\nPlan:",
    )
    return parts[0] + fitted(history, max(0, limit - sum(map(len, parts)))) + parts[1]


def check_prompt(question: str, plan: str, rows: list[dict]) -> str:
    preview = json.dumps(rows, ensure_ascii=False, default=str)
    preview = preview if len(preview) <= MAX_PREVIEW else preview[:MAX_PREVIEW] + " ..."
    return f"A plan ran without an error. Check its logic only: filters and thresholds, the direction of extremes, whether all that was asked is there, the formula.\nQuestion: {question}\nPlan: {plan}\nResult: {preview}\nAnswer TAMAM if it is right or you are not sure, else '{OBJECTION}: <one sentence>'."


def objection(verdict: str) -> str | None:
    """The objection of a verdict; None for any text that does not begin with the prefix."""
    v = verdict.strip()
    if not v.upper().startswith(OBJECTION):
        return None
    return v.split(":", 1)[-1].strip()[:MAX_ISSUE] or None


def warmer(model, attempt: int):
    """The model at a higher temperature, so that it does not repeat itself; itself where it has none."""
    if attempt == 1 or not hasattr(model, "bind"):
        return model
    try:
        return model.bind(temperature=min(STEP_TEMPERATURE * attempt, MAX_TEMPERATURE))
    except Exception:  # a model that refuses is used as it is
        return model


def _text(plan) -> str:
    return plan if isinstance(plan, str) else json.dumps(plan, ensure_ascii=False, sort_keys=True)


def _steps(plan) -> list[dict]:
    if not isinstance(plan, str):
        return plan
    a, b = plan.find("["), plan.rfind("]")
    try:
        out = json.loads(plan[a : b + 1])
    except ValueError as e:
        raise algebra.PlanError(f"not a JSON list of steps: {e}") from None
    if not isinstance(out, list) or not all(isinstance(s, dict) for s in out):
        raise algebra.PlanError("not a JSON list of steps")
    return out


def answer(write, df: DataFrame, question: str, check=None, attempts: int = 3, limit: int = MAX_PROMPT, **options) -> dict:
    """Let a plan be written, run and checked until one holds.

    A failure and an objection both go back to the writer. Returns what run_plan returns, with attempts, plan and
    validation: ok, objection (the first answer that was objected to, as no later one held), failed (the checker
    broke: the answer is taken, validation_error says why) or not_run (without a checker, or at the last attempt).
    Without any answer there are error, status "failed" and service_failure, whether the writer itself broke.
    """
    described = describe(df)
    prompt, history, seen, doubtful, last = plan_prompt(question, described), [], set(), None, ""
    broke = False
    for n in range(1, attempts + 1):
        try:
            plan = warmer(write, n)(prompt)
        except Exception as e:  # another try would meet the same prompt
            last, broke = f"the writer did not answer ({type(e).__name__}): {str(e)[:200]}", True
            break
        form = "".join(_text(plan).split())
        repeated = form in seen
        seen.add(form)
        try:
            ran = algebra.run_plan(df, _steps(plan), **options)
        except algebra.PlanError as e:
            ran = {"error": str(e)}
        if "error" in ran:
            last = ran["error"]
            history.append((_text(plan), last))
            prompt = correction_prompt(question, described, history, repeated, limit)
            continue
        ran |= {"attempts": n, "plan": _text(plan), "validation": "not_run", "validation_error": None}
        if check is None or n == attempts:
            return ran
        try:
            issue = objection(check(check_prompt(question, _text(plan), ran["rows"])))
        except Exception as e:
            return ran | {"validation": "failed", "validation_error": f"{type(e).__name__}: {str(e)[:150]}"}
        if issue is None:
            return ran | {"validation": "ok"}
        history.append((_text(plan), f"The plan ran, but its result does not fit the question: {issue}"))
        prompt = correction_prompt(question, described, history, repeated, limit)
        doubtful = doubtful or ran | {"validation": "objection", "objection": issue}
    if doubtful is not None:
        return doubtful
    return {"error": last, "attempts": attempts, "status": "failed", "service_failure": broke}
