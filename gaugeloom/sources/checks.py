"""Strict JSON checks: an object of exactly four keys, none twice."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

UNKNOWN, MOST = 3, 64


def _once(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key comes twice")
    return out


def parse_check(text: str) -> tuple[int, str, dict[str, tuple[float, str]]]:
    """(state, message, metrics); anything out of shape is state 3 with the reason as message."""
    try:
        doc = json.loads(text, object_pairs_hook=_once)
        if not isinstance(doc, dict) or set(doc) != {"schema", "state", "message", "metrics"} or doc["schema"] != 1:
            raise ValueError("not of schema 1")
        state, metrics = doc["state"], doc["metrics"]
        if type(state) is not int or not 0 <= state <= 3 or not isinstance(doc["message"], str) or not isinstance(metrics, dict) or len(metrics) > MOST:
            raise ValueError("a part has the wrong type or size")
        found = {}
        for label, m in metrics.items():
            if not isinstance(m, dict) or set(m) != {"value", "uom"} or type(m["value"]) not in (int, float) or not math.isfinite(m["value"]):
                raise ValueError(f"metric {label!r} is out of shape")
            found[label] = (float(m["value"]), str(m["uom"]))
        return state, doc["message"], found
    except (ValueError, TypeError, RecursionError) as e:
        return UNKNOWN, str(e), {}


def parse_checks(rows: DataFrame, key: str, output: str = "output") -> DataFrame:
    """(key, state, message, metrics: map of label to (value, uom)) for each row's check output."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [parse_check(t) for t in pdf[output]]
            yield pd.DataFrame({key: pdf[key], "state": [m[0] for m in made], "message": [m[1] for m in made], "metrics": [{k: {"value": v, "uom": u} for k, (v, u) in m[2].items()} for m in made]})

    kind = rows.select(key).schema[0].dataType.simpleString()
    return rows.select(key, output).mapInPandas(work, f"`{key}` {kind}, state int, message string, metrics map<string,struct<value:double,uom:string>>")
