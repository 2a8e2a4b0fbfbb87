"""Task parameters: a JSON object whose values are one-element arrays of text."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class TaskParams:
    """What a job is asked for; None means no filter."""

    start_date: str | None = None
    end_date: str | None = None
    start_age: int | None = None
    end_age: int | None = None
    professionals: tuple[str, ...] | None = None
    cities: tuple[str, ...] | None = None
    sex: str | None = None
    keywords: tuple[str, ...] | None = None
    category_ids: tuple[int, ...] | None = None
    page_flow: tuple[int, ...] | None = None

    @classmethod
    def from_json(cls, text: str) -> TaskParams:
        raw = {k: v[0] for k, v in json.loads(text).items() if v}

        def items(name, kind=str):
            return tuple(kind(x) for x in raw[name].split(",") if x) if raw.get(name) else None

        def number(name):
            return int(raw[name]) if raw.get(name) else None

        return cls(
            raw.get("startDate"), raw.get("endDate"), number("startAge"), number("endAge"), items("professionals"),
            items("cities"), raw.get("sex"), items("keywords"), items("categoryIds", int), items("targetPageFlow", int),
        )

    @classmethod
    def of_task(cls, tasks: DataFrame, task_id: int) -> TaskParams:
        """Reads one row of the task table (task_id, task_param); a missing task is an error."""
        row = tasks.where(tasks["task_id"] == task_id).select("task_param").first()
        if row is None:
            raise LookupError(f"no task {task_id}")
        return cls.from_json(row[0])
