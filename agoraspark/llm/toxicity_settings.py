"""How the settings of the toxicity model are chosen: among labelled rows that may be learned from, never by held-out ones.

    python -m agoraspark.llm.toxicity_settings FOLDER

takes the labels of the rows that toxicity() may learn from, keeps a fifth of them (by a hash of the id) out of a fit for each of the
candidates below, and prints the loss and recall on that fifth. The held-out rows of toxicity() are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from agoraspark.llm import toxicity
from agoraspark.llm.common import table, unit_hash

#: A change of one setting at a time, from those of the module.
CANDIDATES = [{}, {"ALPHA": 0.25}, {"ALPHA": 0.5}, {"ALPHA": 1.0}, {"EPOCHS": 20}, {"DEVIATIONS": 3.0}, {"DEVIATIONS": 5.0}, {"L2": 0.5}]


def learnable(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Terms, labels and whether a row validates, of a sample of the rows that may be learned from."""
    marked = toxicity._marked(labels.filter(~toxicity.held_out("doc_id")))
    kept = {r[0] for r in marked.filter(unit_hash("doc_id") < 0.2).select("doc_id").collect()} if marked.count() < 1_000_000 else None
    if kept is None:
        raise ValueError("choose settings on a table of fewer labels")
    found = toxicity.sampled_rows(docs, marked, toxicity.SAMPLE_PER_CLASS)
    rows = [np.frombuffer(r["terms"], np.uint32).astype(np.int64) for r in found]
    return rows, np.array([r["toxic"] for r in found], int), np.array([r["doc_id"] in kept for r in found], bool)


def validated(rows: list[np.ndarray], label: np.ndarray, out: np.ndarray) -> Iterator[tuple[dict, float, float, float]]:
    """Each candidate with loss, recall and share of others predicted on the rows that are out."""
    known = toxicity.frequent([r for r, o in zip(rows, out, strict=True) if not o])
    at = [(p := toxicity.places(known, r))[p >= 0] for r in rows]
    fitted = [r for r, o in zip(at, out, strict=True) if not o]
    for change in CANDIDATES:
        before = {k: getattr(toxicity, k) for k in change}
        for k, v in change.items():
            setattr(toxicity, k, v)
        bias, w, v = toxicity.fit_machine(fitted, label[~out], len(known))
        for k, value in before.items():
            setattr(toxicity, k, value)
        y = np.array([toxicity.Rows([r]).predict(bias, w, v)[0][0] for r, o in zip(at, out, strict=True) if o])
        p, truth = toxicity.logistic(y), label[out]
        loss = -np.mean(np.log(np.clip(np.where(truth == 1, p, 1 - p), 1e-9, 1)))
        yield change, float(loss), float((p[truth == 1] >= 0.5).mean()), float((p[truth == 0] >= 0.5).mean())


def main(folder: str) -> None:
    spark = SparkSession.builder.getOrCreate()
    rows, label, out = learnable(table(spark, folder, "documents"), table(spark, folder, "labels"))
    print(f"{len(rows)} rows, {out.sum()} of them validate")
    for change, loss, recall, wrong in validated(rows, label, out):
        print(f"{change or 'as set'}: loss {loss:.5f}, recall {recall:.4f}, of others predicted {wrong:.5f}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
