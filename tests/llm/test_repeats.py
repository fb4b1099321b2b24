import base64
import hashlib
import os
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle

from histloom.llm import repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        mask = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                mask[i : i + length] = True
        spans = int((np.diff(mask.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(x, np.uint8)[~mask])
        text = kept.decode("utf-8", "replace")
        out.append((len(x), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(), text))
    return out


@pytest.mark.parametrize("order", [3, 5, 13])
def test_differences_meet_every_residue(order):
    period, offsets = repeats.difference_set(order)
    found = {(a - b) % period for a in offsets.tolist() for b in offsets.tolist()}
    assert found == set(range(period)) and len(offsets) == order + 1


@pytest.mark.parametrize("batch, names", [(4_000_000, 1_000_000), (3_000, 500)])
def test_equals_brute_force(spark, monkeypatch, batch, names):
    monkeypatch.setattr(repeats, "BATCH_BYTES", batch)
    monkeypatch.setattr(repeats, "SORTED_NAMES", names)
    rng = random.Random(batch)

    def fresh(n):
        return "".join(rng.choices("abcdefgh é", k=n))

    passage, exact = fresh(900), fresh(395)
    texts = [fresh(rng.choice([10, 390, 500, 1500])) for _ in range(25)]
    texts += [fresh(200) + passage + fresh(300), fresh(77) + passage[100:620] + fresh(33),
              passage[300:705], passage[:410] + fresh(20) + passage[450:],
              "ab" * 700, "x" * 1000, "x" * 399, "x" * 400, "", None, None,
              fresh(1200)]
    texts += [texts[-1], texts[0], texts[0]]
    edge = "".join(rng.choices("ABCDEFGH", k=400))
    texts += ["p" + edge + "q", "r" + edge + "s", edge[:399] + "t", exact]
    rows = [(None if i == 4 else i, t, "c") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ENDS string")
    got = repeats.repeated_bytes(docs).collect()
    want = [(r[0], *b) for r, b in zip(rows, brute(texts, 400), strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_long_text_and_empty_table(spark):
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefghijklmnop ", k=2_500_000))
    docs = spark.createDataFrame([(1, long), (2, long[1_200_000:1_200_400])], "doc_id int, text string")
    got = {r.doc_id: r for r in repeats.repeated_bytes(docs).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed) == (400, 1, 400)
    cut = (long[:1_200_000] + long[1_200_400:]).encode()
    assert got[1].kept_sha256 == hashlib.sha256(cut).hexdigest() and got[1].text == cut.decode()
    assert repeats.repeated_bytes(docs.filter("false")).count() == 0


def test_workers_need_no_copy_of_the_library(tmp_path):
    """What tasks get runs in a process that cannot import the library, also after use here."""

    difference_set, names = repeats.difference_set, repeats.names

    def work():
        data = np.frombuffer(b"ab" * 400, np.uint8)
        return difference_set()[0], len(set(names(data, np.arange(50), 400).tolist()))

    assert work() == (183, 2)
    sent = base64.b64encode(cloudpickle.dumps(work)).decode()
    assert len(sent) < 100_000
    code = f"import base64, pickle; print(pickle.loads(base64.b64decode('{sent}'))())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120
    )
    assert out.stdout.strip() == "(183, 2)", out.stderr[-500:]
