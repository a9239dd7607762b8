"""The other text operators against plain versions over small inputs."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from surveyloom.llm import ann, decontam, licenses, lm, mixing, quality, simhash, tokens
from surveyloom.llm.common import shared_path

SF = "/root/testdata/sf0.01"


def white(text):
    return [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]


def plain_print(text):
    w = white(text)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """{doc: fp} -> {doc: least doc}, by all pairs."""
    docs = sorted(prints)
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3 and (x := find(a)) != (y := find(b)):
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}


def test_simhash_table(documents, texts):
    prints = {d: plain_print(t) for d, t in texts.items()}
    root = plain_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_digest(documents).collect()}
    assert got == {d: (f"{prints[d]:016x}", root[d]) for d in texts}


def test_simhash_links_of_hot_buckets(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(250)} | {rng.getrandbits(64) for _ in range(200)}
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = plain_components({x: x & (1 << 64) - 1 for x in signed})
    for limit in (simhash.BUCKET, 16):
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, limit=limit)).collect()}
        assert {x: roots.get(x, x) for x in signed} == want


def test_simhash_odd(odd, none):
    got = sorted(((repr(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.simhash_digest(odd).collect()), key=repr)
    assert [g for g in got if g[0] == "2"] == [("2", "0" * 16, 2)]
    assert [g for g in got if g[0] == "4"] == [("4", "0" * 16, 2)]
    assert [g[2] for g in got if g[0] in ("1",)] == [1, 1]
    assert sorted(g[2] for g in got if g[0] == "None") == [1, 2]
    assert simhash.simhash_digest(none).collect() == []


def plain_leaks(items, docs):
    """All passages against all items, verified alone."""
    out = set()
    for i, t in items:
        if not (w := decontam.words(t)):
            continue
        step = max(64, 1 << (len(w) - 1).bit_length())
        q, a = decontam.question_answer(t)
        for d, text in docs:
            p = decontam.words(text)
            for k in range(max(1, -(-len(p) // step))):
                passage = p[k * step : (k + 2) * step]
                if decontam.overlap(q, passage) >= 0.8 and decontam.overlap(a, passage) >= 0.8:
                    out.add((d, i))
    return out


def test_decontamination(spark, documents, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng = random.Random(5)
    docs = [(d, texts[d]) for d in sorted(texts)[:120]]
    for n in range(80):  # items in part, changed and inside other text
        w = decontam.words(rng.choice(items)[1])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "changed"
        docs.append((10_000 + n, " ".join(["before"] * rng.randint(0, 300) + w[rng.randint(0, 2) : len(w) - rng.randint(0, 2)] + ["after"] * rng.randint(0, 90)).upper()))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()]
    want = plain_leaks(items, docs)
    assert len(got) == len(set(got))
    assert set(got) == want
    assert 8 < len([d for d, _ in want if d >= 10_000]) < 72


def test_scores_do_not_depend_on_shards(spark, monkeypatch):
    """BM25 by all items, worked out one by one, with one shard and with many."""
    rng = random.Random(8)
    vocabulary = [f"w{j}" for j in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([8, 20, 90])))) for i in range(60)]
    docs = [(i, f"{rng.choice(items)[1]} and {rng.choice(items)[1]}") for i in range(40)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    df = Counter(t for _, x in items for t in set(x.split()))
    mean = sum(len(x.split()) for _, x in items) / len(items)

    def bm25(item, passage):
        out = 0.0
        for t, c in Counter(item).items():
            if t in passage:
                out += math.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(item) / mean))
        return out

    seen = []
    for size in (decontam.SHARD_BYTES, 500):
        monkeypatch.setattr(decontam, "SHARD_BYTES", size)
        got = {(r["doc_id"], r["item_id"]): r["bm25"] for r in decontam.contaminated(*frames).collect()}
        assert set(got) == plain_leaks(items, docs)
        seen.append(got)
        for (d, i), score in got.items():
            assert abs(score - bm25(items[i][1].split(), set(docs[d][1].split()))) < 1e-9
    assert len(list(decontam.shards(frames[1], "item_id", "text"))) > 10
    assert seen[0] == pytest.approx(seen[1])
    assert decontam.drop_contaminated(*frames).count() == 0


def test_block_max_wand_finds_all_above():
    rng = random.Random(2)
    items = [(i, " ".join(rng.choices([f"w{j}" for j in range(60)], weights=[1 / (j + 1) for j in range(60)], k=rng.randint(5, 20)))) for i in range(150)]
    index = decontam.build_index(items, 64)
    for _ in range(60):
        query = sorted({index.terms[t] for t in rng.choices(sorted(index.terms), k=25)})
        score = defaultdict(float)
        for t in query:
            for i, x in zip(index.items[t].tolist(), index.weights[t].tolist(), strict=True):
                score[i] += x
        got = dict(decontam.block_max_wand(index, query))
        want = {i: s for i, s in score.items() if s >= 1}
        assert got.keys() == want.keys()
        assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_decontamination_odd(spark, odd, none):
    items = spark.createDataFrame([(1, "one two three four"), (2, None), (3, ""), (None, "wort wort wort")], "item_id long, text string")
    got = sorted(repr((r["doc_id"], r["item_id"])) for r in decontam.contaminated(odd, items).collect())
    assert got == sorted(["(1, 1)", "(1, 1)", "(None, 1)", "(5, None)"])
    assert decontam.contaminated(none, items).collect() == []
    assert decontam.contaminated(odd, items.limit(0)).collect() == []
    assert decontam.drop_contaminated(odd, items).count() == 5
    assert decontam.drop_contaminated(odd, items).columns == odd.columns


def near(rows, k=10):
    """Brute force over {vec_id: vector}."""
    out = {}
    for q in rows:
        if q % 100 == 0:
            all_ = sorted((float(np.sqrt(((np.array(rows[i], float) - np.array(rows[q], float)) ** 2).sum())), i) for i in rows if i != q and len(rows[i]) == len(rows[q]))
            out[q] = all_[:k]
    return out


def test_neighbours_recall(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r["vec_id"]: r["embedding"] for r in frame.collect()}
    want = near(rows)
    found = defaultdict(list)
    for r in ann.ann_search(frame).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(found[r["query_id"]])
    assert found.keys() == want.keys()
    assert all(len(x) == 10 and x == sorted(x) for x in found.values())
    exact = {q: {i: s for s, i in near({q: rows[q]} | {i: rows[i] for _, i in x})[q]} for q, x in found.items()}
    assert all(abs(exact[q][i] - s) < 1e-12 for q, x in found.items() for s, i in x)
    assert np.mean([len({i for _, i in found[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9


def test_neighbours_over_many_tasks(spark, monkeypatch):
    """12,000 vectors in clusters of very unequal density, a third of the rows copies of one, dealt in small ranges."""
    rng = np.random.default_rng(3)
    centres, spread = rng.normal(size=(30, 24)), rng.uniform(0.02, 1.5, 30)
    which = rng.integers(0, 30, 8000)
    x = centres[which] + rng.normal(size=(8000, 24)) * spread[which][:, None]
    x = np.concatenate([x, np.tile(x[5], (4000, 1))])[rng.permutation(12_000)]
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(12_000), "embedding": x.tolist()}))
    monkeypatch.setattr(ann, "SHARD_ROWS", 256)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 16)
    found, measured = defaultdict(list), {}
    for r in ann.nearest(frame).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        measured[r["query_id"]] = r["n_measured"]
    assert len(found) == 120
    share = []
    for q, got in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(12_000), d)).tolist() if i != q][:10]
        assert [r for r, _, _ in sorted(got)] == list(range(1, 11))
        assert all(abs(d[i] - s) < 1e-12 for _, i, s in got)
        share.append(len({i for _, i, _ in got} & set(want)) / 10)
    assert np.mean(share) >= 0.9
    assert np.median(list(measured.values())) < 0.5 * 8001  # repeats in several trees included


def test_neighbours_of_many_lengths(spark):
    """More lengths than rows of one length: none is left out."""
    rows = [(100 * n + i, [1.0] * n + [float(i)]) for n in range(1, 40) for i in range(2)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(100 * n, 1, 100 * n + 1, 1.0) for n in range(1, 40)]


def test_neighbours_odd(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 0.0]), (8, [-3.0, 4.0]), (9, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.5]), (200, []), (300, [0.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, rank int, score string")
    for size in (8192, 1):
        monkeypatch.setattr(ann, "SHARD_ROWS", size)
        got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.ann_search(frame).collect())
        assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 8, round(math.sqrt(32), 6)), (100, 1, 9, 0.5)]
    assert ann.ann_search(frame.limit(0)).collect() == []


def plain_ids(texts):
    t = tokens._tokenizer(tokens.tokenizer_file())
    return {d: [*t.encode(x or "", add_special_tokens=False).ids, 2] for d, x in texts.items()}


def test_tokens_table(documents, texts):
    want, at = {}, 0
    for d, ids in sorted(plain_ids(texts).items()):
        want[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.token_digest(documents).collect()}
    assert got == want


def test_tokens_odd(spark, odd, none):
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"]) for r in tokens.token_digest(odd).collect()))
    assert [d for _, d, _ in got] == [None, None, 1, 1, 2, 3, 4, 5, 6]
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert got[4][2] == got[5][2] == 1
    assert tokens.token_digest(none).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_pieces_give_the_same_ids(seed):
    rng = random.Random(seed)
    bits = ["a", "Wort", "don't", "Éa,", "'s", "(x)", "wörtlich.", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "×", "÷.", "Ã,", "\u3000", "“", "\nA", "?!", "_", "a_b.", "９.", "😀", "1234", "...", "<|endoftext|>", "\0", " ", " ", "'ll", "x.y", "\x1c", "\x85"]
    encode = tokens.Encoder(tokens.tokenizer_file(), None)
    for _ in range(1500):
        text = "".join(rng.choices(bits, k=rng.randint(0, 25)))
        assert np.frombuffer(encode(text), encode.kind).tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_tokens_round_trip_and_access(spark, documents, texts):
    path = tokens.write_tokens(documents, tokens.tokenizer_file(), shared_path(spark, "t"))
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    assert dictionary
    seg = tokens.Segment(bytes(spark.read.parquet(f"{path}/segments").first()["data"]), dictionary)
    k = len(seg.ids) // 2
    assert seg.tokens(k).tolist() == plain_ids({seg.ids[k]: texts[seg.ids[k]]})[seg.ids[k]]
    with pytest.raises(ValueError, match="another dictionary"):
        tokens.Segment(bytes(spark.read.parquet(f"{path}/segments").first()["data"]), b"x")


def test_tokens_in_many_parts(spark, texts):
    """5,000 documents, some with a repeated id, some with none, one with the least id that there is."""
    rng, some = random.Random(4), sorted(texts.values(), key=len)[:200]
    rows = [(rng.choice([None, 7, 8, i, i, i, i, i]), rng.choice(some)) for i in range(5000)] + [(-(1 << 63), "the least")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    path = tokens.write_tokens(docs, tokens.tokenizer_file(), shared_path(spark, "t"))
    parts = [r["part"] for r in spark.read.parquet(f"{path}/segments").select("part").collect()]
    assert len(set(parts)) > 4
    got = tokens.read_tokens(spark, path, "ids array<int>", lambda x: (x.tolist(),)).collect()
    encode = tokens.Encoder(tokens.tokenizer_file())
    ids = {t: tuple(encode.tokenizer.encode(t, add_special_tokens=False).ids) + (2,) for t in {t for _, t in rows}}
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((d, ids[t]) for d, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        at += len(r["ids"])
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    for d in (7, 4990, -(1 << 63), 10_000):
        assert Counter(tuple(r["ids"]) for r in tokens.read_document(spark, path, d).collect()) == Counter(ids[t] for x, t in rows if x == d)


def test_the_memo_may_be_full():
    encode = tokens.Encoder(tokens.tokenizer_file())
    encode.MOST = 50
    rng = random.Random(1)
    for _ in range(200):
        text = " ".join("".join(rng.choices("abcdé", k=rng.randint(1, 3))) for _ in range(40))
        assert np.frombuffer(encode(text), encode.kind).tolist() == [*encode.tokenizer.encode(text, add_special_tokens=False).ids, 2]
    assert len(encode.memo) + len(encode.older) < 300


@pytest.mark.parametrize("seed", range(20))
def test_schedule_keeps_to_the_weights(seed):
    """Against the weights themselves: until a source runs out each has had its share of every slot, to within a block."""
    rng = random.Random(seed)
    n = rng.randint(1, 12)
    blocks, weights = [rng.randint(1, 400) for _ in range(n)], [rng.uniform(0.01, 5) for _ in range(n)]
    run = list(mixing.placed(blocks, weights))
    assert Counter(s for s, _, _ in run) == Counter({s: b for s, b in enumerate(blocks)})
    assert all([b for s, b, _ in run if s == i] == list(range(blocks[i])) for i in range(n))
    count = [0] * n
    for t, (s, _, phase) in enumerate(run):
        if phase or max(c >= b for c, b in zip(count, blocks, strict=True)):
            break
        count[s] += 1
        assert all(abs(c - (t + 1) * w / sum(weights)) < 1 + 1e-9 for c, w in zip(count, weights, strict=True))
    ends = sorted(b / w for b, w in zip(blocks, weights, strict=True))
    for end in ends:  # at the virtual time of each end too
        t = sum(min(b, end * w) for b, w in zip(blocks, weights, strict=True))
        had = Counter(s for s, _, _ in run[: round(t)])
        assert all(abs(had[i] - min(b, end * w)) < 2 for i, (b, w) in enumerate(zip(blocks, weights, strict=True)))


def test_mixture_table(documents):
    """Unequal weights over the whole table, against a plain count of slots; each source in the order of its hash."""
    weights = {"src0": 5.0, "src1": 0.5}
    rows = sorted(mixing.mixed(documents, weights, block=4).collect(), key=lambda r: r["position"])
    source = {r["doc_id"]: r["source"] for r in documents.collect()}
    assert {r["doc_id"]: r["source"] for r in rows} == source
    assert len(rows) == len(source)
    assert len({r["position"] for r in rows}) == len(rows)
    n = Counter(source.values())
    names = sorted(n)
    w = {s: weights.get(s, 0.5) for s in names}
    slots = {}
    for r in rows:
        assert r["position"] // 4 == r["slot"]
        assert slots.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
    assert sorted(slots) == list(range(sum(-(-k // 4) for k in n.values())))
    count = Counter()
    for t in range(len(slots)):
        if any(count[s] >= -(-n[s] // 4) for s in names):
            break
        count[slots[t][0]] += 1
        assert all(abs(count[s] - (t + 1) * w[s] / sum(w.values())) < 1 + 1e-9 for s in names)
    assert sum(count.values()) > 5
    key = {r["doc_id"]: r["k"] for r in documents.select("doc_id", F.xxhash64("doc_id").alias("k")).collect()}
    for s in names:
        own = [key[r["doc_id"]] & (1 << 64) - 1 for r in rows if r["source"] == s]
        assert own == sorted(own)


def test_mixture_odd(odd, none):
    got = mixing.source_mixture(odd).collect()
    assert Counter(repr(r["doc_id"]) for r in got) == Counter(repr(r["doc_id"]) for r in odd.collect())
    assert len({r["position"] for r in got}) == len(got)
    assert mixing.source_mixture(none).collect() == []
    kept = mixing.in_mixed_order(odd)
    assert kept.columns == odd.columns
    assert kept.count() == odd.count()
    weighted = mixing.mixed(odd, {"a": 1.0, "b": -3.0}).collect()  # no weight for the null source, a bad one for b
    assert Counter(repr(r["doc_id"]) for r in weighted) == Counter(repr(r["doc_id"]) for r in odd.collect())


def test_licenses(spark, odd, none):
    mit = dict(licenses.KNOWN[:1])["MIT"]
    texts = ["Copyright (c) 2020 Somebody\n" + mit.replace("license", "licence").replace(" ", "  ").upper(), "text\n  released UNDER the mit licence!\nmore", mit + " and more", "", None, "© 2021 A\nLicensed under CC BY-NC 4.0."]
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i]["text_license"] for i in range(6)] == ["MIT", None, None, None, None, "CC-BY-NC-4.0"]
    assert [rows[i]["n_notices"] for i in range(6)] == [0, 1, 0, 0, 0, 1]
    assert rows[1]["notice_licenses"] == "MIT"
    assert sorted(repr(r["doc_id"]) for r in licenses.scan_licenses(odd).collect()) == sorted(repr(r["doc_id"]) for r in odd.collect())
    assert licenses.scan_licenses(none).collect() == []


def test_licence_texts_may_be_wrapped(spark):
    """A whole text counts whatever its line breaks, case, marks and spellings, with notices about it or without."""
    import re
    import textwrap

    rng, known, texts = random.Random(9), licenses.KNOWN, []
    for name, text in known:
        for width in (30, 61, 79, 10_000):
            own = "\n".join(x for p in text.split("\n") for x in textwrap.wrap(p, width, break_long_words=False))
            own = re.sub(r"\blicense\b", "licence", own).replace("copyright holders", "copyright owners")
            head = rng.choice(["", "Copyright (c) 2021 Some Body\n", "© Some Body\n\n", "Copyright 1999-2003 A, B\nAll rights reserved.\n"])
            texts.append((name, head + (own.upper() if rng.random() < 0.3 else own)))
    rows = {r["doc_id"]: r["text_license"] for r in licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()}
    assert [rows[i] for i in range(len(texts))] == [n for n, _ in texts]


def plain_words(text):
    """Line by line and word by word."""
    import re

    out = []
    for line in (text or "").split("\n"):
        for sign in ("©", "(c)", "(C)"):
            line = line.replace(sign, " \x01 ")
        words = [w if w == "\x01" else w.lower() for w in re.findall("[A-Za-z0-9]+|\x01", line)]
        notice = words[:1] == ["\x01"] or words[:2] == ["copyright", "\x01"] or (words[:1] == ["copyright"] and any(re.fullmatch("(19|20)[0-9][0-9]", w) for w in words[1:])) or words[:3] == ["all", "rights", "reserved"]
        words = [w for w in words if w != "\x01"]
        if not notice:
            out += words
    for a, b in licenses.EQUAL:
        a, b, i = a.split(), b.split(), 0
        while i < len(out):
            if out[i : i + len(a)] == a:
                out[i : i + len(a)] = b
                i += len(b)
            else:
                i += 1
    return out


def test_canonical_form_is_plain(spark, texts):
    import hashlib

    more = ["licence licence licences", "Copyright holder\ncopyright holders of 1999", "copyright\n(c) x", "http http://a sub-licence sub licence", "Copyright x 2020", "©", "(C)(c) a", "copyright 20201 a", "x\ty\r\nz"]
    docs = list(enumerate([*sorted(texts.values())[:300], *more]))
    got = {r["doc_id"]: r["text_digest"] for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: hashlib.md5(" ".join(plain_words(t)).encode()).hexdigest() for i, t in docs}


def test_whole_public_texts(spark):
    import os

    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    folder = "/usr/share/common-licenses"
    if not all(os.path.exists(f"{folder}/{n}") for n in names):
        pytest.skip("the texts aren't here")
    rows = []
    for i, n in enumerate(names):
        with open(f"{folder}/{n}") as f:
            rows.append((i, " ".join(w for w in f.read().replace("\n", " \n ").split(" ") if w)))
    got = {r["doc_id"]: r["text_license"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(names))] == list(names.values())


def test_licenses_sql(spark, documents):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(licenses.license_sql()).fetchall())
    assert sorted(map(tuple, licenses.scan_licenses(documents).collect())) == want
    assert sum(r[3] for r in want) > 20


def test_quality(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality(documents, labels).collect()
    assert len(rows) == documents.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in held]) > 0.93
    assert np.mean([b for a, b in held if a == 1]) > 0.97


def test_quality_learns_no_held_out_label(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    assert {round(r["score"], 12) for r in quality.quality(documents, labels).collect()} == {0.5}


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert quality.quality(odd, labels).count() == odd.count()
    assert quality.quality(none, labels).collect() == []
    assert quality.keep_good(odd, labels).columns == odd.columns


def plain_base(texts):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts = Counter(w for d, t in texts.items() if not held[d] for w in [*white(t), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for d, t in texts.items():
        w = [*white(t), None]
        out[d] = (held[d], len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
    return out


@pytest.mark.parametrize("head", [1 << 18, 50])
def test_lm(documents, texts, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    rows = lm.lm_scores(documents).collect()
    want = plain_base(texts)
    assert len(rows) == len(want)
    for r in rows:
        x = want[r["doc_id"]]
        assert tuple(r)[1:5] == x[:4]
        assert abs(r["base_score"] - x[4]) < 1e-6 * abs(x[4])
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_is_a_distribution():
    rng = np.random.default_rng(1)
    table = rng.normal(size=(lm.TABLE, lm.CLASSES)).astype(np.float32)
    rows, cls = lm.features([lm.encoded(t, lm.Memo(lm._code))[1] for t in (b"a b c a", b"")])
    assert rows.shape == (6, lm.FEATURES)
    assert cls[4] == cls[5] == 0
    assert np.allclose(np.exp(lm.class_log_probs(table, rows)).sum(1), 1, atol=1e-5)


def test_lm_odd(odd, none):
    rows = lm.lm_scores(odd).collect()
    assert Counter(repr(r["doc_id"]) for r in rows) == Counter(repr(r["doc_id"]) for r in odd.collect())
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (2, 3, 4))
    assert lm.lm_scores(none).collect() == []


def test_class_column_is_word_class(spark):
    words = [b"a", b"ab", b"abc", "éa".encode(), b"zzzzz", "ñ".encode(), b"x" * 300]
    frame = spark.createDataFrame([(bytearray(w),) for w in words], "word binary").select("word", lm.class_column(F.col("word")).alias("c"))
    assert [r["c"] for r in frame.collect()] == [lm.word_class(w) for w in words]
