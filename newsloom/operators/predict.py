"""Classifiers as functions over DataFrames: any model, or deterministic ones that need none.

A classifier is ``predict(df) -> df`` with pred_label, pred_score, pred_margin, pred_top_labels and
pred_top_scores added. ``batched`` makes one from a plain function that scores a list of texts; it loads
once per Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import decide
from .ruleset import FAILED

# Fixed values.
HYPOTHESIS = "이 뉴스의 핵심 주제는 {}입니다."
BATCH = 4

Scorer = Callable[[list[str]], list[dict[str, float]]]


def with_prediction(df: DataFrame, labels: Column, scores: Column) -> DataFrame:
    # arrays first, then what reads them: each is computed once for a row
    out = df.withColumns({"pred_all_labels": labels, "pred_all_scores": scores})
    out = out.withColumn("pred", decide.prediction(F.col("pred_all_labels"), F.col("pred_all_scores")))
    names = {"pred_label": "label", "pred_score": "score", "pred_margin": "margin", "pred_top_labels": "top_labels", "pred_top_scores": "top_scores"}
    return out.withColumns({k: F.col(f"pred.{v}") for k, v in names.items()}).drop("pred", "pred_all_labels", "pred_all_scores")


def batched(load: Callable[[], Scorer], text: str, batch: int = BATCH) -> Callable[[DataFrame], DataFrame]:
    """A classifier from load(), which returns a function from texts to {label: score}.

    A blank text fails alone; an exception fails its batch's rows: label FAILED, score 0.
    """

    @F.pandas_udf("labels array<string>, scores array<double>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for part in parts:
            texts = [x or "" for x in part]
            rows: list[tuple[list, list]] = [([], []) for _ in texts]
            wanted = [i for i, x in enumerate(texts) if x.strip()]
            for at in range(0, len(wanted), batch):
                some = wanted[at : at + batch]
                try:
                    found = scorer([texts[i] for i in some])
                    if len(found) != len(some):
                        raise ValueError("as many predictions as texts are needed")
                except Exception:  # noqa: BLE001 - any failure of a model is a failed prediction
                    continue
                for i, one in zip(some, found):
                    rows[i] = (list(one), [float(v) for v in one.values()])
            yield pd.DataFrame(rows, columns=["labels", "scores"])

    def predict(df: DataFrame) -> DataFrame:
        return with_prediction(df.withColumn("scored", score(text)), F.col("scored.labels"), F.col("scored.scores")).drop("scored")

    return predict


def zero_shot(load: Callable[[], Callable], labels: list[str], described: dict[str, str] | None = None, template: str = HYPOTHESIS, batch: int = BATCH) -> Callable[[], Scorer]:
    """A load() for batched() from one that gives an entailment pipeline: called with sequences, candidate_labels, hypothesis_template,
    multi_label and batch_size, it returns for each text its labels and scores. Each label is asked for by its description; without
    descriptions by its own short name."""
    asked = [(described or {}).get(x, x) for x in labels]
    if not labels or len(set(labels)) < len(labels) or len(set(asked)) < len(asked) or not all(x.strip() for x in asked):
        raise ValueError("labels and their descriptions must be there, not blank and different")
    named = dict(zip(asked, labels))

    def made() -> Scorer:
        model = load()

        def score(texts: list[str]) -> list[dict[str, float]]:
            found = model(sequences=texts, candidate_labels=asked, hypothesis_template=template, multi_label=False, batch_size=batch)
            return [dict(zip([named[x] for x in one["labels"]], one["scores"], strict=True)) for one in ([found] if isinstance(found, dict) else found)]

        return score

    return made


def by_shares(df: DataFrame, text: Column, words: dict[str, list[str]]) -> DataFrame:
    """df with predictions: each label's share of the listed words in a lower-case text, in the JVM. No such word: zeros."""
    letters = "[a-zà-ÿß]"
    listed = sorted({w for ws in words.values() for w in ws if re.fullmatch(f"{letters}+", w)}, key=lambda w: (-len(w), w))
    # one pass for the words of all labels
    found = F.regexp_extract_all(text, F.lit(f"(?<!{letters})(?:{'|'.join(listed)})(?!{letters})"), F.lit(0)) if listed else F.lit(None)
    out = df.withColumn("share_words", F.coalesce(found, F.array().cast("array<string>")))
    out = out.withColumn("share_counts", F.array(*[F.size(F.filter("share_words", lambda w: w.isin(ws))) for ws in words.values()]))  # noqa: B023 - called at once
    out = out.withColumn("share_total", F.aggregate("share_counts", F.lit(0), lambda a, x: a + x))
    shares = F.transform("share_counts", lambda x: F.when(F.col("share_total") > 0, x.cast("double") / F.col("share_total")).otherwise(F.lit(0.0)))
    return with_prediction(out, F.array(*map(F.lit, words)), shares).drop("share_words", "share_counts", "share_total")


def centroid_scores(df: DataFrame, vector: str, centroids: dict[str, list[float]]) -> tuple[Column, Column]:
    """Labels and cosine similarities (0 at least) to given centroids; vectors are arrays."""

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)

    v = F.col(vector)
    norm = F.sqrt(dot(v, v))
    cosines = []
    for c in centroids.values():
        lit = F.array(*map(F.lit, c))
        length = sum(x * x for x in c) ** 0.5
        cosines.append(F.greatest(F.lit(0.0), F.coalesce(dot(v, lit) / F.when(norm * length > 0, norm * length), F.lit(0.0))))
    return F.array(*map(F.lit, centroids)), F.array(*cosines)


def problems(labels: list[str]) -> list[Column]:
    """rows, failed, unknown_labels, bad_scores, as metrics of a table with predictions; all but rows are 0 for sound ones."""
    odd = F.col("pred_label").isNull() | ~F.col("pred_label").isin(FAILED, *labels)
    bad = F.isnan("pred_score") | ~F.col("pred_score").between(0.0, 1.0) | F.isnan("pred_margin") | ~F.col("pred_margin").between(0.0, 1.0) | (F.col("pred_margin") > F.col("pred_score"))
    return [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("pred_label") == FAILED).alias("failed"), F.count_if(odd).alias("unknown_labels"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad_scores")]


def check(df: DataFrame, labels: list[str]) -> DataFrame:
    """One row of the problems."""
    return df.agg(*problems(labels))
