"""The pipeline's near-copy stage against exact shingle similarity."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from joinlift.llm import shingles

SCHEMA = "doc_id long, text string, lang string, source string"


def shingle_words(text):
    parts = text.lower().split()
    k = min(5, len(parts))
    return {tuple(parts[i:i + k]) for i in range(len(parts) - k + 1)} if k else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x or y else 1.0


def planted(rng, words, target):
    """A copy whose five-word similarity lies just above the target: words are changed as long as it does."""
    own = shingle_words(" ".join(words))
    copy = list(words)
    while True:
        tried = list(copy)
        tried[int(rng.integers(len(words)))] = f"new{rng.integers(1 << 40)}"
        if jaccard(own, shingle_words(" ".join(tried))) < target:
            return copy
        copy = tried


def test_stage_links_planted_copies_and_nothing_below(spark):
    rng = np.random.default_rng(5)
    texts = []
    for target in (0.8, 0.85, 0.9, 0.95):
        for _ in range(25):
            base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
            texts += [" ".join(base), " ".join(planted(rng, base, target)), " ".join(planted(rng, base, 0.7))]
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    texts += [" ".join([*base, f"tail{i}"]) for i in range(40)] + [" ".join(base)] * 20         # one dense group
    texts += ["", None, "  ", "one two", "ONE  two", "one two three"]
    frame = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], SCHEMA).repartition(4)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, "").collect())

    sets = [shingle_words(t or "") for t in texts]
    least = list(range(len(texts)))
    changed = True
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (sets[i] & sets[j] or not sets[i] | sets[j])
             and jaccard(sets[i], sets[j]) >= 0.8]
    while changed:
        changed = False
        for i, j in pairs:
            low = min(least[i], least[j])
            changed |= least[i] != low or least[j] != low
            least[i] = least[j] = low
    assert got == sorted(set(least))
    assert sum(least[i] != i for i in range(1, 300, 3)) == 100


def test_bands_meet_as_often_as_similarity_says():
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(300):
        common, own = rng.integers(0, 1 << 63, 800, np.uint64), rng.integers(0, 1 << 63, 200, np.uint64)
        x, y = np.unique(np.concatenate([common, own[:100]])), np.unique(np.concatenate([common, own[100:]]))
        met += (shingles.bands(x) == shingles.bands(y)).sum()
    assert abs(met / 300 / shingles.BANDS - 0.8 ** shingles.ROWS) < 0.03


def test_stage_takes_the_links_of_simhash(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(f"w{x}" for x in rng.integers(0, 5000, 400)), "", None]
    frame = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], SCHEMA)
    named = [np.uint64(shingles.set_name(shingles.shingle_set(t.encode(), 5))).view(np.int64) for t in texts[:2]]
    rows = shingles.store(shingles.sketches(frame, "doc_id", "text", 5))
    assert [sorted(r) for r in shingles._by_simhash(rows).collect()] == [sorted(named)]
    seen = []
    found = shingles.simhash.links
    monkeypatch.setattr(shingles.simhash, "links", lambda *a: seen.append(a) or found(*a))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, "").collect()) == [0, 2, 3]
    assert len(seen) == 1


def test_shingles_are_made_of_few_texts_at_a_time(monkeypatch):
    monkeypatch.setattr(shingles, "PIECE_BYTES", 10)
    column = pa.array(["a b c", None, "d" * 30, "", "e f", "g h i j"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), column], ["id", "text"])
    runs = list(shingles.pieces(iter([batch, batch.slice(0, 0), batch.slice(3)]), 1))
    assert [r["id"].to_pylist() for r in runs] == [[0, 1], [2], [3, 4, 5], [3, 4, 5]]
    assert pa.Table.from_batches(runs)["text"].to_pylist() == column.to_pylist() + column.to_pylist()[3:]
