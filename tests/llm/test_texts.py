"""Language, quality, near-duplicates, token files, BPE, mixing and sharding against brute force on small hostile tables."""

import hashlib
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers as public
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from joinlift.llm import bpe, language, mixing, quality, queries, sharding, simhash, token_file

SF = "/root/testdata/sf0.001"
WORDS = {"en": "the of and to in is that it was for on are with as his they be at one have this".split(),
         "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split(),
         "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour".split(),
         "es": "el de que y a en un ser se no haber por con su para como estar tener le lo todo".split()}
#: Extra columns bear names that the operators use themselves.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, hash string, fp int, "
          "component_id long, score double, shard int, n long, id long, weight int, language string")


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]


def prose(lang, seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS[lang], n))


def hostile():
    texts = [prose(lang, i, 60) for i, lang in enumerate(["en", "de", "fr", "es"] * 8)]
    base = prose("en", 99, 400)
    texts += [base] * 5 + [base + f" tail{i}" for i in range(6)] + [base.replace("the", "THE")]
    texts += [None, "", "", " \t\n", "one", "one two three", "\x1c \x85\xa0é  漢字\n\n x", "a" * 3000, "<|endoftext|> !!!"]
    texts += [prose("de", 5, 20_000), "0123 4567 8910 " * 30]
    rows = [(i * 3, t, ["en", "de", "fr", "es"][i % 4], ["b", "a", "Z", None, "é"][i % 5]) for i, t in enumerate(texts)]
    rows += [(None, "no id at all here", "en", "a"), (None, None, None, None), (0, texts[0], "en", "b"),
             (0, texts[0], "en", "b"), (3, "another text under an id that is taken", "xx", "a")]
    return [(*r, None, 1, "h", 2, 3, 0.5, 4, 5, 6, 7, "l") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hostile(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# op1

def test_language_is_found_and_evidence_is_fused(spark):
    rows = [(i, prose(lang, i, 40), lang, f"{lang}.site{i % 3}.example.{lang}") for i, lang in
            enumerate(["en", "de", "fr", "es"] * 40)]
    rows += [(900, prose("de", 7, 30), "en", "de.site0.example.de"),          # a wrong declaration
             (901, "%% 12 ## 99 @@ 00 && ==", "en", None), (902, None, "en", "x"), (903, "", None, None),
             (904, "漢字仮名交じり文" * 20, "zz", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in language.identify(frame).collect()}
    assert len(got) == len(rows)
    for i, _, lang, _ in rows[:160]:
        assert got[i]["language"] == lang and got[i]["confidence"] > 0.9
    assert got[900]["language"] == "de"
    assert [got[i]["language"] for i in (901, 902, 903, 904)] == ["und"] * 4
    kept = {r["doc_id"] for r in language.keep_identified(frame).collect()}
    assert kept == {r[0] for r in rows[:160]} | {900}


def test_host_priors_match_a_plain_computation(spark):
    rows = [("a.x.com", [0.0, -1.0, -9.0]), ("a.x.com", [0.0, -3.0, -9.0]), ("b.x.com", [-2.0, 0.0, -9.0]),
            ("c.y.com", [-5.0, 0.0, -9.0]), ("plain", [0.0, 0.0, -9.0]), ("none.org", None)]
    frame = spark.createDataFrame(rows, "__host string, __ll array<double>")
    got = {r["__host"]: np.array(r["prior"]) for r in language.host_priors(frame, 3).collect()}

    def p(x):
        e = np.exp(np.array(x) - max(x))
        return e / e.sum()

    sums = defaultdict(lambda: np.zeros(3))
    for host, ll in rows:
        parts = host.split(".")
        suffix, domain = (parts[-1], ".".join(parts[-2:])) if len(parts) > 1 else ("", host)
        for key in ("all", ("s", suffix), ("d", domain), ("h", host)):
            sums[key] = sums[key] + (p(ll) if ll else 0)
    smooth = lambda own, above: (own + language.STRENGTH * above) / (own.sum() + language.STRENGTH)
    top = (sums["all"] + 1) / (sums["all"].sum() + 3)
    for host in got:
        parts = host.split(".")
        suffix, domain = (parts[-1], ".".join(parts[-2:])) if len(parts) > 1 else ("", host)
        want = smooth(sums["h", host], smooth(sums["d", domain], smooth(sums["s", suffix], top)))
        assert np.allclose(got[host], want)


def test_trigrams_do_not_cross_texts():
    model = language.TextModel(("x",), np.vstack([np.arange(language.BUCKETS), np.zeros(language.BUCKETS)]).astype(float))
    alone = [model.score(pa.array([t]))[0][0, 0] for t in ("abcdef", "é", "", "xyz abc")]
    together = model.score(pa.array(["abcdef", "é", "", None, "xyz abc"]))[0][:, 0]
    assert np.allclose(together, [alone[0], alone[1], 0, 0, alone[3]])


def test_language_on_hostile_and_empty(docs, none):
    assert language.identify(docs.select("doc_id", "text", "lang", "source")).count() == docs.count()
    assert language.keep_identified(docs).columns == docs.columns
    assert language.keep_identified(none).count() == 0


# op2

def plain_fingerprint(text, words):
    parts = text.encode().lower().split()
    if not parts:
        return 0
    k = min(words, len(parts))
    h = [xxhash.xxh64_intdigest(b" ".join(parts[i:i + k]), 42) for i in range(len(parts) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {n: find(n) for n in nodes}


def test_near_duplicates_match_brute_force(docs):
    rows = [(r["doc_id"], plain_fingerprint(r["text"] or "", 4)) for r in docs.select("doc_id", "text").collect()]
    comp = plain_components(sorted({f for _, f in rows}), lambda a, b: (a ^ b).bit_count() <= 4)
    first = defaultdict(list)
    for d, f in rows:
        if d is not None:
            first[comp[f]].append(d)
    want = sorted(((d, f, min(first[comp[f]], default=None)) for d, f in rows), key=str)
    got = [(d, f % 2 ** 64, c) for d, f, c in rows_of(simhash.near_duplicates(docs))]
    assert sorted(got, key=str) == want


@pytest.mark.parametrize("segments,chunk", [(3, 2048), (3, 5), (2, 3), (4, 50)])
def test_links_connect_what_all_pairs_connect(spark, segments, chunk):
    rng = np.random.default_rng(segments)
    fps = set(rng.integers(0, 2 ** 63, 40).tolist())
    for f in list(fps)[:6]:                                           # dense groups, and chains out of them
        for _ in range(30):
            f2 = f
            for b in rng.integers(0, 63, rng.integers(1, 7)):
                f2 ^= 1 << int(b)
            fps.add(f2)
    fps = sorted(fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    frame = simhash.store(frame)
    links = rows_of(simhash.links(frame, segments=segments, chunk=chunk))
    want = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    pairs = {frozenset(x) for x in links}
    root = plain_components(fps, lambda a, b: frozenset((a, b)) in pairs)
    assert root == want
    got = dict(rows_of(simhash.components(spark.createDataFrame(links, "a long, b long"), "a", "b")))
    assert {f: got.get(f, f) for f in fps} == want


def test_one_document_of_each_group_stays(docs, none):
    rows = [(r["doc_id"], r["text"], plain_fingerprint(r["text"] or "", 5)) for r in docs.collect()]
    comp = plain_components(sorted({f for *_, f in rows}), lambda a, b: (a ^ b).bit_count() <= 4)
    kept = simhash.keep_first(docs, words=5)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], comp[plain_fingerprint(r["text"] or "", 5)]) for r in kept.collect()]
    assert sorted(c for _, c in got) == sorted(set(comp.values()))
    for d, c in got:
        ids = [i for i, _, f in rows if comp[f] == c and i is not None]
        assert d == min(ids, default=None)
    assert simhash.keep_first(none).count() == 0


# op3

def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for values in ([5], [7] * 100, [0, 2 ** 32 - 1] * 20, rng.integers(0, 50_000, 4096), rng.integers(0, 2 ** 32, 999),
                   [*range(300), 4_000_000_000]):
        values = np.array(values, np.uint32)
        assert (token_file.unpack_block(b"xy" + token_file.pack_block(values), 2) == values).all()
    few = np.array([*rng.integers(100, 164, 4000), *[60_000] * 40], np.uint32)
    assert len(token_file.pack_block(few)) < 4040 * 6 / 8 + 40 * 6 + 20          # outliers don't widen the block


def test_token_file_matches_the_library(spark, docs, none, tmp_path):
    path = public.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    token_file.write(docs, str(tmp_path / "f"), path, public.PATTERN)
    got = sorted(rows_of(token_file.read(spark, str(tmp_path / "f"))), key=lambda r: r[1])
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    at = 0
    for doc_id, start, n, ids in got:
        assert start == at and n == len(ids) // 4
        texts[doc_id].remove(bytes(ids))
        at += n
    assert not any(texts.values())
    order = [r[0] for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    crc = {(r[0], r[1]): r[3] for r in rows_of(token_file.index(spark, str(tmp_path / "f")))}
    assert crc == {(d, s): zlib.crc32(ids) for d, s, _, ids in got}
    token_file.write(none, str(tmp_path / "g"), path, public.PATTERN)
    assert token_file.read(spark, str(tmp_path / "g")).count() == 0


def test_a_block_is_read_by_its_index():
    docs = [(i, np.arange(i, i + 3000, dtype=np.uint32)) for i in range(5)]
    row = token_file._segment(0, 0, 0, docs)
    whole = np.concatenate([x for _, x in docs])
    for a, b in ((0, 15_000), (4096, 4097), (5000, 9000), (14_999, 15_000)):
        assert (token_file.read_segment(row, a, b) == whole[a:b]).all()


# op6

def test_bpe_matches_the_library_and_decodes(docs, none):
    path = public.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = []
    for r in docs.collect():
        ids = plain.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(rows_of(bpe.round_trip(docs, path, public.PATTERN)), key=str) == sorted(want, key=str)
    assert bpe.round_trip(none, path, public.PATTERN).count() == 0
    ids = bpe.encode(docs.select("text"), path, public.PATTERN)
    back = bpe.decode(ids, path, public.PATTERN)
    assert sorted(bytes(r[0]) for r in back.collect()) == sorted((r["text"] or "").encode() for r in docs.collect())


def test_bpe_on_random_characters():
    path = public.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    coder = bpe.Coder.of(path, public.PATTERN)
    rng = np.random.default_rng(1)
    alphabet = list("abTHE the's  \n\t\x0b\x1c\x1f\x85\xa0\u3000é漢0١½.,!#_’") + ["ing", "\u0301", "\U0001f600", "\u200b"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 50))) for _ in range(500)] + ["ab" * 1500, " " * 500, "漢" * 900]
    assert [bpe.parse(x).tolist() for x in coder.encode(texts)] == [plain.encode_ordinary(t) for t in texts]
    assert coder.decode([bpe.parse(x) for x in coder.encode(texts)]) == [t.encode() for t in texts]


# op5

def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * rest > 3 * sizes[s] * w}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * rest / w for s in names}
        capped |= over


def test_mix_comes_near_its_targets(spark, docs, none):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), f"s{int(rng.integers(0, 7)) ** 2 % 11}") for i in range(3000)]
    big = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, hash int")
    for frame, granular in ((big, True), (docs, False)):
        got = mixing.mix(frame).toPandas()
        source = [(r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in frame.collect()]
        assert sorted(got["size"]) == sorted(s for *_, s in source)
        sizes = defaultdict(int)
        for _, s, n in source:
            sizes[s] += n
        want = plain_targets(sizes)
        assert sorted(set(zip(got.source_size, got.target.round(6)))) == sorted({(sizes[s], round(t, 6)) for s, t in want.items()})
        assert (got.taken <= 3 * got["size"]).all()
        assert ((got.taken % got["size"].clip(lower=1)) == 0).all()
        if granular:
            for (_, target), own in got.groupby(["source_size", "target"]):
                assert abs(own.taken.sum() - target) <= own["size"].max()
        again = mixing.mix(frame.repartition(5)).toPandas()
        cols = ["doc_id", "size", "target", "taken"]
        assert got[cols].sort_values(cols, ignore_index=True).equals(again[cols].sort_values(cols, ignore_index=True))
    assert mixing.mix(none).count() == 0
    mixed = mixing.repeat(docs)
    assert mixed.columns == docs.columns
    taken = mixing.mix(docs).groupBy("doc_id").agg({"taken": "sum"}).toPandas()
    words = sum(len((r["text"] or "").encode().split()) for r in mixed.collect())
    assert words == taken["sum(taken)"].sum()


def test_threshold_is_that_of_a_sort(spark):
    rows = [((i * 2654435761) % 2 ** 48, i % 9) for i in range(500)]
    frame = mixing.store(spark.createDataFrame([(("s",), s, h) for h, s in rows],
                                               "skey struct<source:string>, size long, hash long"))
    for budget in (0.0, 0.4, 100.0, 777.5, 1e9):
        b = spark.createDataFrame([(("s",), 500, budget)], "skey struct<source:string>, n long, budget double")
        below = mixing.thresholds(frame, b).first()["below"]
        got = sum(s for h, s in rows if h < below)
        sums = [0, *itertools.accumulate(s for _, s in sorted(rows))]
        assert abs(got - budget) == min(abs(x - budget) for x in sums)


# op7

def test_shards_are_level_and_groups_stay_together(spark, docs, none):
    for frame, shards in ((spark.read.parquet(f"{SF}/documents.parquet"), 7), (docs, 3)):
        rows = sharding.shard(frame, shards=shards).collect()
        got = pd.DataFrame([r.asDict() for r in rows])
        want = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode()))
                       for r in frame.collect()), key=str)
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == want
        assert (got.groupby("text_crc32").shard.nunique() == 1).all()
        for _, own in got.groupby("shard"):
            assert sorted(own.slot) == list(range(len(own)))
        loads = got.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0)
        largest = got.groupby("text_crc32")["size"].sum().max()
        assert loads.max() - loads.min() <= largest
    assert sharding.shard(none).count() == 0


def test_schedule_is_longest_first():
    assert sharding.schedule([(3, "c"), (5, "a"), (4, "b"), (3, "d")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_groups_of_one_size_are_handed_out_as_one_by_one():
    rng = np.random.default_rng(3)
    for trial in range(200):
        shards = int(rng.integers(1, 9))
        sizes = {int(s): int(rng.integers(1, rng.choice([3, 60]))) for s in rng.choice([40, 400], 1)[0] - rng.integers(0, 40, 12)}
        if trial % 3 == 0:
            sizes[5_000] = 1                                          # one group that the others have to catch up with
        items = [(size, f"{size}-{i}") for size, n in sizes.items() for i in range(n)]
        want: dict[int, dict[int, int]] = {}
        for name, to in sharding.schedule(items, shards).items():
            of_size = want.setdefault(int(name.split("-")[0]), {})
            of_size[to] = of_size.get(to, 0) + 1
        assert dict(sharding.hand_out(sorted(sizes.items(), reverse=True), shards)) == want


def test_rows_repeated_beyond_a_slice_get_gapless_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE_ROWS", 20)
    rows = [(1, "again and again")] * 150 + [(None, None)] * 40 + [(i, f"text {i % 60}") for i in range(300)]
    got = pd.DataFrame([r.asDict() for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()])
    assert len(got) == len(rows) and (got.groupby("text_crc32").shard.nunique() == 1).all()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    sizes = got.groupby("text_crc32")["size"].sum()
    placed = sharding.schedule([(n, str(c)) for c, n in sizes.items()], 4)
    want = sorted(sum(n for c, n in sizes.items() if placed[str(c)] == s) for s in range(4))
    assert sorted(got.groupby("shard")["size"].sum()) == want


# op10

def test_trees_learn_and_flat_arrays_agree_with_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit_trees(x, y, trees=30)
    assert (((model.score(x) > 0.5) == y).mean()) > 0.95
    for row, s in zip(x[:50], model.score(x[:50])):
        total = model.base
        for f, c, leaf in zip(model.feature, model.cut, model.leaf):
            i = 0
            while i < len(f):
                i = 2 * i + 1 + int(row[f[i]] > c[i])
            total += leaf[i - len(f)]
        assert s == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op10_quality(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert set(held.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4)) == {2}
    order = held.score.rank()
    good, bad = order[held.quality == 1], order[held.quality == 0]
    auc = (good.sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    assert auc > 0.9 and (held.predicted == held.quality).mean() > 0.9
    assert got.score.between(0, 1).all()


def test_quality_on_hostile_and_empty(spark, docs, none):
    labels = spark.createDataFrame([(0, 1), (3, 0), (3, 1), (6, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert quality.score(docs.drop("score"), model).count() == docs.count()
    assert quality.keep_good(docs, model).columns == docs.columns
    empty = quality.fit(none, labels)
    assert quality.keep_good(none, empty).count() == 0
    assert {r["score"] for r in quality.score(docs.select("doc_id", "text"), empty).collect()} == {0.5}


def test_pieces_with_white_space_among_many_plain_ones():
    path, pattern = queries.tokenizer("byte_bpe_50k.json"), queries.split_pattern()
    new = {*(f"w{i}" for i in range(token_file.AT_ONCE * 3)), "", "a\tb", "c\n", "\u00a0d", "e\u2003f"}
    many, single = token_file.Encoder(path, pattern), token_file.Encoder(path, pattern)
    many._know(new)
    assert many.known == dict(zip(new, single._ids([" " + p for p in new])))
    texts = ["w1 w2 w3", "w1 new w2", "", "w5\tx w6  y"]
    assert many.encode(texts) == [np.array(many.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
