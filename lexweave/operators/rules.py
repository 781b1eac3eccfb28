"""Declarative questionnaires over answer maps.

A questionnaire is compiled at plan time: every question becomes a visibility
column and every effect a flag column, each built from the ones before it, so a
whole questionnaire is one projection over the answers, inside code generation
and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS = {"ja": "voldaan", "nee": "actie", "nvt": "nvt"}
LABEL = {"ja": "Ja", "nee": "Nee", "nvt": "N.v.t."}


@dataclass(frozen=True)
class Question:
    id: str
    text: str = ""
    show_if: dict | None = None
    effects: tuple[tuple[tuple[str, ...], str], ...] = ()  # (answers that set it, flag)
    obligation: bool = False
    options: tuple[tuple[str, str], ...] = ()
    column_code: str | None = None


@dataclass(frozen=True)
class Module:
    id: str
    questions: tuple[Question, ...]
    show_if: dict | None = None


@dataclass(frozen=True)
class Compiled:
    """Columns of a questionnaire over one answers column."""

    flags: dict[str, Column]
    modules: dict[str, Column]
    questions: dict[str, Column]
    source: tuple[Module, ...] = field(default=())


def condition(tree: dict, flags: dict[str, Column], answers: Column) -> Column:
    """A condition tree as a column: all, any, not, flag, answer, in this precedence; an empty tree holds."""
    if "all" in tree:
        out = F.lit(True)
        for t in tree["all"]:
            out = out & condition(t, flags, answers)
        return out
    if "any" in tree:
        out = F.lit(False)
        for t in tree["any"]:
            out = out | condition(t, flags, answers)
        return out
    if "not" in tree:
        return ~condition(tree["not"], flags, answers)
    if "flag" in tree:
        return flags.get(tree["flag"], F.lit(False))
    if "answer" in tree:
        wanted = tree["answer"].get("is", tree["answer"].get("options"))
        return F.coalesce(answers[tree["answer"]["q"]].isin(list(wanted) if isinstance(wanted, (list, tuple)) else [wanted]), F.lit(False))
    return F.lit(True)


def compiled(modules: tuple[Module, ...], answers: Column, derive: Callable[[dict[str, Column]], dict[str, Column]] | None = None) -> Compiled:
    """One forward pass at plan time; hidden questions set no flags, empty answers neither.

    ``derive`` may add flags from those known before each module, each question
    and at the end.
    """
    flags: dict[str, Column] = {}
    seen_modules: dict[str, Column] = {}
    seen: dict[str, Column] = {}

    def step() -> None:
        if derive:
            flags.update(derive(dict(flags)))

    for module in modules:
        step()
        shown = condition(module.show_if, flags, answers) if module.show_if else F.lit(True)
        seen_modules[module.id] = shown
        for q in module.questions:
            step()
            visible = shown & condition(q.show_if, flags, answers) if q.show_if else shown
            seen[q.id] = visible
            for wanted, flag in q.effects:
                hit = visible & F.coalesce(answers[q.id].isin([w for w in wanted if w != ""]), F.lit(False))
                flags[flag] = flags[flag] | hit if flag in flags else hit
    step()
    return Compiled(flags, seen_modules, seen, modules)


def evaluated(records: DataFrame, modules: tuple[Module, ...], answers: str = "answers", derive=None) -> DataFrame:
    """Records with sorted ``flags``, and ``visible_modules`` and ``visible_questions`` in order."""
    c = compiled(modules, F.col(answers), derive)

    def true_names(columns: dict[str, Column]) -> Column:
        named = [F.when(v, F.lit(k)) for k, v in columns.items()]
        return F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")

    return records.select("*", F.array_sort(true_names(c.flags)).alias("flags"), true_names(c.modules).alias("visible_modules"), true_names(c.questions).alias("visible_questions"))


def questions_of(modules: tuple[Module, ...]) -> Column:
    """All questions as an array literal, in order."""
    rows = [(m.id, q.id, q.text, q.obligation, i) for i, (m, q) in enumerate((m, q) for m in modules for q in m.questions)]
    return F.array(*[F.struct(F.lit(m).alias("module_id"), F.lit(q).alias("question_id"), F.lit(t).alias("question_text"), F.lit(o).alias("obligation"), F.lit(i).alias("pos")) for m, q, t, o, i in rows])


def visible_questions(evaluation: DataFrame, modules: tuple[Module, ...], key: str, answers: str = "answers") -> DataFrame:
    """One row for each visible question of each record, with its answer."""
    rows = evaluation.select(key, "visible_questions", F.col(answers).alias("a"), F.explode(questions_of(modules)).alias("q")).filter(F.array_contains("visible_questions", F.col("q.question_id")))
    return rows.select(key, "q.*", F.col("a")[F.col("q.question_id")].alias("answer"))


def obligations(evaluation: DataFrame, modules: tuple[Module, ...], key: str, answers: str = "answers") -> DataFrame:
    """Visible obligations with their status; anything but the three known answers is open."""
    status = F.lit("open")
    for answer, name in STATUS.items():
        status = F.when(F.col("answer") == answer, name).otherwise(status)
    return visible_questions(evaluation, modules, key, answers).filter("obligation").select(key, "module_id", "question_id", "pos", status.alias("status"))


def obligation_groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """Obligations per group: all, met, and whether any needs attention."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_obligations"), F.count_if(F.col("status") == "voldaan").alias("n_met"), F.bool_or(F.col("status").isin("actie", "open")).alias("needs_attention"))


def column_answers(evaluation: DataFrame, modules: tuple[Module, ...], key: str, answers: str = "answers") -> DataFrame:
    """Visible questions that fill a column, with the column's code and the answer."""
    filling = [(q.id, q.column_code) for m in modules for q in m.questions if q.column_code]
    table = F.array(*[F.struct(F.lit(q).alias("question_id"), F.lit(c).alias("column_code")) for q, c in filling]) if filling else F.array().cast("array<struct<question_id:string,column_code:string>>")
    shown = F.filter(table, lambda x: F.array_contains("visible_questions", x["question_id"]))
    return evaluation.select(key, F.col(answers).alias("_a"), F.explode(shown).alias("x")).select(key, "x.question_id", "x.column_code", F.col("_a")[F.col("x.question_id")].alias("answer"))


def progress(evaluation: DataFrame, modules: tuple[Module, ...], key: str, answers: str = "answers") -> DataFrame:
    """Answered and visible questions of each record, counted inside its row."""
    visible, a = F.col("visible_questions"), F.col(answers)
    answered = F.size(F.filter(visible, lambda q: F.coalesce(a[q], F.lit("")) != ""))
    return evaluation.select(key, answered.alias("answered"), F.size(visible).alias("total"))


def first_incomplete_module(rows: DataFrame, key: str) -> DataFrame:
    """The first module with a visible question that has no answer."""
    empty = rows.filter(F.coalesce("answer", F.lit("")) == "")
    return empty.groupBy(key).agg(F.min_by("module_id", "pos").alias("module_id"))


def answer_label(question: Question, value: Column) -> Column:
    """A choice's own label, else the label of yes, no and not applicable, else the value; empty for none."""
    names = dict(question.options) if question.options else LABEL
    out = value
    for answer, name in names.items():
        out = F.when(value == answer, name).otherwise(out)
    return F.coalesce(out, F.lit(""))


def split_by(rows: DataFrame, column: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the named groups and all the others."""
    inside = F.coalesce(F.col(column).isin(values), F.lit(False))
    return rows.filter(inside), rows.filter(~inside)


def ladder(evaluation: DataFrame, steps: list[tuple[dict, str]], otherwise: str, name: str = "outcome", answers: str = "answers") -> DataFrame:
    """The first outcome whose condition holds, conditions reading the record's flags and answers."""
    wanted = {f for tree, _ in steps for f in _flags_of(tree)}
    flags = {f: F.array_contains("flags", f) for f in wanted}
    out = None
    for tree, label in steps:
        holds = condition(tree, flags, F.col(answers))
        out = F.when(holds, label) if out is None else out.when(holds, label)
    return evaluation.withColumn(name, F.lit(otherwise) if out is None else out.otherwise(otherwise))


def _flags_of(tree: dict) -> set[str]:
    below = [*tree.get("all", ()), *tree.get("any", ()), *([tree["not"]] if "not" in tree else ())]
    return ({tree["flag"]} if "flag" in tree else set()).union(*(_flags_of(t) for t in below))


def timeline(records: DataFrame, dates: list[tuple[str, str, str | None]], key: str) -> DataFrame:
    """Fixed dates ``(day, label, flag or none)`` of each record, those whose flag it has, in order of day."""
    table = F.array(*[F.struct(F.lit(d).alias("day"), F.lit(i).alias("pos"), F.lit(t).alias("label"), F.lit(f).cast("string").alias("flag")) for i, (d, t, f) in enumerate(dates)])
    kept = F.filter(F.array_sort(table), lambda x: x["flag"].isNull() | F.array_contains("flags", x["flag"]))
    return records.select(key, F.posexplode(kept).alias("place", "x")).select(key, "place", "x.day", "x.label")
