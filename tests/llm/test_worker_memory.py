"""What Python workers hold: Spark keeps them for later stages, so lattices end with their task, and keys leave in slices."""

import gc
import random

import numpy as np
import pandas as pd
import pyarrow as pa

from offerlens.llm import near_dedup, segmentations


def test_no_lattices_after_a_task():
    alive = lambda: sum(isinstance(x, segmentations.Lattices) for x in gc.get_objects())
    gc.collect()
    before, within = alive(), []
    batches = [pa.RecordBatch.from_pydict({"id": pa.array([i], pa.int64()), "text": ["the same frequent words"]}) for i in range(segmentations.CHOSEN_FROM + 2)]
    for _ in segmentations._rows(segmentations.model_path(), 2)(iter(batches)):
        within.append(alive() - before)
    gc.collect()
    assert within[-1] > 0 and alive() == before


def test_keys_of_changes_leave_in_slices(monkeypatch):
    draw, rows = random.Random(3), []
    for i in range(40):
        n, shared = draw.randrange(100, 300), [draw.getrandbits(62) for _ in range(draw.choice((1, 5, 12, 30)))]
        # the tag is the pattern, of an id that no double can hold
        rows.append((2**60 + i, i % 3, 2**60 + 1, i % 2 == 0, n, n, len(shared), shared))
    batch = pd.DataFrame(rows, columns=["class_id", "part", "ref", "linked", "n", "ref_n", "changes", "shared"])
    whole = pd.concat(near_dedup._change_keys(iter([batch])), ignore_index=True)
    one_class = max(len(x) for i in range(len(batch)) for x in near_dedup._change_keys(iter([batch.iloc[i : i + 1]])))
    monkeypatch.setattr(near_dedup, "KEYS", 64)
    slices = list(near_dedup._change_keys(iter([batch])))
    assert len(slices) > 20 and max(map(len, slices)) < 64 + one_class
    assert pd.concat(slices, ignore_index=True).equals(whole)
    linked = set(batch["class_id"][batch["linked"]])
    assert [t == 2**60 + 1 if c in linked else t is pd.NA for c, t in zip(whole["class_id"], whole["tag"])] == [True] * len(whole)
    assert np.array_equal(whole["many"], whole["class_id"].map(dict(zip(batch["class_id"], batch["shared"].map(len)))))
