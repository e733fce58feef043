"""Model-backed steps: a skill is a name, a result type and a backend that is swapped in.

No model is available here; the stand-ins below are rules.  They exercise the plumbing and say nothing about
quality.  A backend gets a list of inputs and gives a list of results, one each.  Its errors become the ``error``
field of their rows; ``Pause`` is never an item's error and ends the job.

A skill whose ``answers`` are JSON has each answer read and held against its result type: fields that are missing, of
another type or out of range make an error, fields that the type does not name are dropped or an error, as ``extra``
says.  Rows without a valid answer are asked again, at most ``retries`` times, and keep their last answer.

``apply`` may be told which rows to ask about; no other row reaches the backend.  Select only what it needs, and write
its result before splitting on it: a deterministic function would else run once for each branch.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Backend = Callable[[list], list]


class Pause(Exception):
    """Stops a run; what is done stays done.  No error isolation takes it for an item's error."""


class Invalid(ValueError):
    """An answer that does not have the skill's result type."""


_WHOLE = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def validated(value: object, kind: T.DataType, extra: str = "drop", at: str = "answer") -> object:
    """``value``, read from JSON, as ``kind``; raises Invalid where it is not.

    Null is valid anywhere, an absent field is not.  Whole numbers are valid floating ones; nothing else is converted.
    """
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            raise Invalid(f"type: {at} is no object")
        missing = [f.name for f in kind.fields if f.name not in value]
        if missing:
            raise Invalid(f"missing: {at}.{missing[0]}")
        unknown = sorted(set(value) - set(kind.names))
        if unknown and extra == "error":
            raise Invalid(f"extra: {at}.{unknown[0]}")
        return {f.name: validated(value[f.name], f.dataType, extra, f"{at}.{f.name}") for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            raise Invalid(f"type: {at} is no list")
        return [validated(v, kind.elementType, extra, f"{at}[{k}]") for k, v in enumerate(value)]
    if isinstance(kind, T.StringType) and isinstance(value, str) or isinstance(kind, T.BooleanType) and isinstance(value, bool):
        return value
    if isinstance(value, bool) or not isinstance(value, int | float):
        raise Invalid(f"type: {at} is no {kind.simpleString()}")
    if isinstance(kind, T.FloatType | T.DoubleType):
        if not math.isfinite(value):
            raise Invalid(f"range: {at}")
        return float(value)
    if type(kind) in _WHOLE and isinstance(value, int):
        if not -(1 << _WHOLE[type(kind)]) <= value < 1 << _WHOLE[type(kind)]:
            raise Invalid(f"range: {at}")
        return value
    raise Invalid(f"type: {at} is no {kind.simpleString()}")


@dataclass(frozen=True)
class Skill:
    name: str
    #: DDL of the result.
    kind: str
    backend: Backend
    #: Inputs that one call takes.
    batch: int = 64
    #: What the backend gives: "values", or "json" texts that are held against ``kind``.
    answers: str = "values"
    #: What becomes of fields of a JSON answer that ``kind`` lacks: "drop", or "error".
    extra: str = "drop"
    #: How often rows without a valid answer are asked again.
    retries: int = 0

    def apply(self, rows: DataFrame, inputs: Sequence[str], target: str, ask: Column | None = None) -> DataFrame:
        """``rows`` with ``target``: (result, error, answer, tries) of the skill on the struct of ``inputs``.

        ``answer`` is the text of a JSON answer that is not valid.  Rows for which ``ask`` is not true have no result, no
        error and no tries.
        """
        asked = F.lit(True) if ask is None else F.coalesce(ask, F.lit(False))
        skill, kind = self, T.DataType.fromDDL(self.kind)

        @F.pandas_udf(f"struct<result: {self.kind}, error: string, answer: string, tries: int>")
        def run(values: pd.DataFrame) -> pd.DataFrame:
            given = values.drop(columns="_ask").to_dict("records")
            found: list[tuple] = [(None, None, None, 0)] * len(given)
            todo = [k for k, wanted in enumerate(values["_ask"]) if wanted]
            for tries in range(1, skill.retries + 2):
                for at in range(0, len(todo), skill.batch):
                    part = todo[at : at + skill.batch]
                    for k, (result, error, answer) in zip(part, skill.answered([given[k] for k in part], kind), strict=True):
                        found[k] = result, error, answer, tries
                todo = [k for k in todo if found[k][1] is not None]
            return pd.DataFrame({name: pd.Series(list(column), dtype=kind_) for name, column, kind_ in zip(("result", "error", "answer", "tries"), zip(*found, strict=True) if found else ((), (), (), ()), ("object", "object", "object", "int32"), strict=True)})

        return rows.withColumn(target, run(F.struct(*inputs, asked.alias("_ask"))))

    def answered(self, inputs: list, kind: T.DataType) -> list[tuple]:
        """(result, error, answer) of each input, from one call."""
        try:
            answers = self.backend(inputs)
            if len(answers) != len(inputs):
                raise ValueError(f"{len(answers)} results for {len(inputs)} inputs")
        except Pause:
            raise
        except Exception as e:  # noqa: BLE001
            return [(None, f"{type(e).__name__}: {e}"[:500], None)] * len(inputs)
        return [self.read(a, kind) if self.answers == "json" else (a, None, None) for a in answers]

    def read(self, answer: str | None, kind: T.DataType) -> tuple:
        """(result, error, answer) of a JSON answer."""
        try:
            return validated(json.loads(answer or ""), kind, self.extra), None, None
        except Invalid as e:
            return None, f"Invalid: {e}"[:500], answer
        except (ValueError, TypeError, RecursionError):
            return None, "Invalid: malformed", answer


def error_counts(rows: DataFrame, error: str) -> DataFrame:
    """(kind, errors): how often each class of error occurs."""
    kind = F.substring_index(F.col(error), ":", 1)
    return rows.where(F.col(error).isNotNull()).groupBy(kind.alias("kind")).agg(F.count("*").alias("errors"))


REGISTRY: dict[str, Skill] = {}


def register(skill: Skill) -> Skill:
    REGISTRY[skill.name] = skill
    return skill


def _words(text: object) -> list[str]:
    return str(text or "").split()


def _counted(text: object) -> list[str]:
    """The words of four letters or more, most frequent first and ties by the smaller one."""
    times: dict[str, int] = {}
    for w in re.split(r"[\s.,]+", str(text or "").lower()):
        if len(w) >= 4:
            times[w] = times.get(w, 0) + 1
    return sorted(times, key=lambda w: (-times[w], w))


def _shows(images: object, what: str) -> bool:
    return any(what in str(i) for i in (images if images is not None else ()))


def _brief(x: dict) -> dict:
    text = " ".join(_words(x.get("text")))
    return {"clean": text, "brief": " ".join(text.split()[:12]), "prohibited": "weapon" in text.lower()}


def _title(x: dict) -> dict:
    return {"title": " ".join([str(x["title"] or ""), *x["main"]]).strip()[:60], "prohibited": _shows(x["images"], "weapon")}


def _tags(x: dict) -> list[str]:
    return list(dict.fromkeys([*x["main"], *x["secondary"]]))[:5]


def _inpainted(x: dict) -> str:
    return x["path"].replace("mark-", "", len(x["boxes"])) + ".clean"


def _verified(x: dict) -> dict:
    """Marks and stickers that are left are in the boxes; addresses may be anywhere."""
    return {"in_boxes": "mark" in x["candidate"] or "sticky" in x["candidate"], "whole": ["rival_url"] if "url" in x["candidate"] else []}


#: Rule stand-ins.  Those of the text sub-stages see what the one before made, and the images' paths.
CLASSIFY = register(Skill("classify", "string", lambda xs: [(_words(next(iter(x.values())))[-1:] or ["other"])[0].lower() for x in xs]))
TRANSLATE = register(Skill("translate", "string", lambda xs: [" ".join(w[::-1] for w in _words(next(iter(x.values())))) for x in xs]))
BRIEF = register(Skill("brief", "struct<clean: string, brief: string, prohibited: boolean>", lambda xs: [json.dumps(_brief(x)) for x in xs], answers="json", retries=1))
TERMS = register(Skill("terms", "struct<main: array<string>, secondary: array<string>>", lambda xs: [json.dumps({"main": t[:2], "secondary": t[2:5]}) for t in (_counted(x["clean"]) for x in xs)], answers="json", retries=1))
TITLE = register(Skill("title", "struct<title: string, prohibited: boolean>", lambda xs: [json.dumps(_title(x)) for x in xs], answers="json", retries=1))
TAGS = register(Skill("tags", "array<string>", lambda xs: [json.dumps(_tags(x)) for x in xs], answers="json", retries=1))
REJECT_SCAN = register(Skill("reject_scan", "string", lambda xs: ['{"reject_indices": [%s], "reject_scores": [%s]}' % (", ".join(str(i) for i, p in enumerate(x["paths"]) if "reject" in p), ", ".join("0.9" for p in x["paths"] if "reject" in p)) for x in xs], batch=1))
LOCATE = register(Skill("locate", "array<struct<x0: double, y0: double, x1: double, y1: double>>", lambda xs: [[{"x0": 0.0, "y0": 0.0, "x1": 0.1, "y1": 0.1}] if "mark" in x["path"] else [] for x in xs]))
INPAINT = register(Skill("inpaint", "string", lambda xs: [_inpainted(x) for x in xs], batch=8))
VERIFY = register(Skill("verify", "struct<in_boxes: boolean, whole: array<string>>", lambda xs: [_verified(x) for x in xs]))
EDIT_FIRST = register(Skill("edit_first", "string", lambda xs: [None if "closeup" in x["path"] else x["path"] + ".edited" for x in xs], batch=1))
