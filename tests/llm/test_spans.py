"""Secret and PII scans against plain regular expressions over whole texts."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from surveyloom.llm import pii, secretscan


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


SECRET = {
    "assign": (re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}
PERSONAL = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
}


def plain(kinds, text):
    found = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds.values()) for m in p.finditer(text or "") if ok(m))
    names = list(kinds)
    return [f"{names[k]}:{a}:{b}" for a, k, b in found]


def row_of(kinds, text):
    spans = plain(kinds, text)
    counts = [sum(s.startswith(f"{k}:") for s in spans) for k in kinds]
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest())


def holds_base(row, kinds, text):
    return set(plain(kinds, text)) <= set(row["spans"].split(","))


@pytest.mark.parametrize(("query", "kinds"), [(secretscan.secret_digest, SECRET), (pii.pii_digest, PERSONAL)])
def test_whole_table(documents, texts, query, kinds):
    rows = query(documents).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1 : len(kinds) + 2] == row_of(kinds, texts[r["doc_id"]])
        assert holds_base(r, kinds, texts[r["doc_id"]])
    assert sum(sum(tuple(r)[1 : len(kinds) + 1]) for r in rows) > 10


@pytest.mark.parametrize(("query", "kinds"), [(secretscan.secret_digest, SECRET), (pii.pii_digest, PERSONAL)])
def test_odd_rows(odd, none, query, kinds):
    got = sorted((repr(r["doc_id"]), *tuple(r)[1 : len(kinds) + 2]) for r in query(odd).collect())
    assert got == sorted((repr(r["doc_id"]), *row_of(kinds, r["text"])) for r in odd.collect())
    assert query(none).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_random_text(spark, seed):
    rng = random.Random(seed)
    bits = ["token", "Api_Key", "PASSWD", "=", ":", " ", "'", '"', "abcdefghijkl", "0f", "0123456789abcdef", "AKIA", "ABCDEFGHIJ1234", "@", "x.y", "-", ".", "1.2.3.4", "256", "9", "4111 1111 1111 1111", "+1", "(212)", "555", "é", "😀", "\n", "%"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for query, kinds in ((secretscan.secret_digest, SECRET), (pii.pii_digest, PERSONAL)):
        for r in query(docs).collect():
            assert tuple(r)[1 : len(kinds) + 2] == row_of(kinds, texts[r["doc_id"]]), texts[r["doc_id"]]


def test_trigram_queries():
    assert secretscan.trigram_query("[0-9a-f]+") == secretscan.ALL
    assert secretscan.trigrams(secretscan.trigram_query("AKIA[A-Z0-9]+")) == {b"aki", b"kia"}
    query = secretscan.trigram_query("abc(def|xyz)?q|uvwx")
    assert query[0] == "or"
    assert b"uvw" in secretscan.trigrams(query)


@pytest.mark.parametrize("rule", secretscan.RULES, ids=lambda r: r.kind)
def test_index_loses_no_match(rule):
    samples = ["password: hunter2hunter2", "API_KEY='abcdefghijklmn'", "AKIA" + "A" * 16, "0123456789abcdef0", "ghp_" + "a1" * 20, "glpat-" + "x" * 20, "xoxb-1234567890ab", "AIza" + "b" * 35, "sk_live_" + "c" * 20,
               "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "-----BEGIN RSA PRIVATE KEY-----", "https://user:secretpw@host", "ftp://" + "u" * 90 + ":" + "p" * 200 + "@host", "nothing", ""]
    raw = [s.encode() for s in samples]
    query = secretscan.trigram_query(rule.pattern, rule.flags)
    got = set(secretscan.candidates(query, secretscan.BlockIndex(secretscan.trigrams(query) or {b"zzz"}).postings(raw), len(raw)).tolist())
    hit = {i for i, s in enumerate(samples) if re.search(rule.pattern, s, rule.flags)}
    assert hit
    assert hit <= got


def test_added_spans(spark):
    texts = ["x ghp_" + "a1" * 20 + " y", "phone: (212) 555-0100 now", "write to jane at example dot com"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert any(r["spans"].startswith("github:2:") for r in secretscan.secret_digest(docs).collect())
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in pii.pii_digest(docs).collect())


def test_label_model_tells_reliable_from_noisy():
    rng = random.Random(1)
    rows = {}
    for _ in range(4000):
        true = rng.random() < 0.4
        votes = tuple((1 if true else -1) if rng.random() < p else (-1 if true else 1) for p in (0.95, 0.9, 0.85, 0.5))
        rows[votes] = rows.get(votes, 0) + 1
    post, table = pii.vote_model(list(rows.items()))
    found = dict(zip(rows, post, strict=True))
    assert found[1, 1, 1, -1] > 0.95
    assert found[-1, -1, -1, 1] < 0.05
    assert table[0, 1, 2] > 0.9
    assert abs(table[3, 1, 2] - 0.5) < 0.1


def test_vote_model_is_plain_em():
    """The same steps written out one by one."""
    rng = random.Random(4)
    rows = {}
    for _ in range(300):
        v = tuple(rng.choice((-1, 0, 1)) for _ in range(3))
        rows[v] = rows.get(v, 0) + 1
    data = list(rows.items())
    post = [1 / (1 + math.exp(-sum(v))) for v, _ in data]
    for _ in range(100):
        table = [[[1.0] * 3 for _ in range(2)] for _ in range(3)]
        for (v, n), p in zip(data, post, strict=True):
            for j in range(3):
                table[j][0][v[j] + 1] += n * (1 - p)
                table[j][1][v[j] + 1] += n * p
        table = [[[x / (c[0] + c[2]) for x in c] for c in t] for t in table]
        prior = (sum(n * p for (_, n), p in zip(data, post, strict=True)) + 1) / (sum(n for _, n in data) + 2)
        new = []
        for v, _ in data:
            odds = [1 - prior, prior]
            for j in range(3):
                odds = [o * (table[j][c][v[j] + 1] if v[j] else 1) for c, o in enumerate(odds)]
            new.append(odds[1] / sum(odds))
        if max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-9:
            break
        post = new
    got = pii.vote_model(data)[0]
    assert max(abs(a - b) for a, b in zip(got, post, strict=True)) < 1e-6


def test_groups_are_judged_apart():
    """A labeler that is reliable for one group and noise for another: what it says of the one doesn't carry over."""
    keys = ["phone|1,1,1,0,0,1|1|s", "number|-1,-1,0,0,-1,-1|1|w", "card|1,1,0,0,0,1|2|s", "card_within|0,-1,0,0,0,-1|2|w"]
    alone = pii.soft_labels(keys[:2], [50, 50])
    both = pii.soft_labels(keys, [50, 50, 3, 900])
    assert np.allclose(both[:2], alone)
    assert alone[0] > 0.9 > 0.1 > alone[1]


def test_span_classifier_is_at_its_optimum():
    """No small change of one key's logit by a shared part lowers the loss: compared with plain gradient descent."""
    keys = ["phone|1,1,1,0,0,1|1|s", "phone|1,-1,1,0,0,1|1|s", "phone_local|0,1,0,1,0,1|1|s", "phone_local|0,-1,0,0,-1,-1|1|p", "number|-1,-1,0,0,0,-1|1|w"]
    counts, soft = [90, 10, 20, 15, 40], np.array([0.99, 0.9, 0.8, 0.1, 0.02])
    names = sorted({x for k in keys for x in parts_of(k)})
    x = np.array([[n in parts_of(k) for n in names] + [True] for k in keys], dtype=float)
    c = np.sqrt(counts) / np.sqrt(counts).sum()
    w = np.zeros(x.shape[1])
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 0.5 * (x.T @ (c * (p - soft)) + 1e-4 * w)
    assert np.allclose(pii.span_classifier(keys, counts, soft), 1 / (1 + np.exp(-x @ w)), atol=1e-3)


def parts_of(key):
    kind, vote, size, around = key.split("|")
    return {kind, f"{kind}{size}", f"{kind}{around}", *(f"{pii.GROUPS[kind]}{j}{v}" for j, v in enumerate(vote.split(",")))}


def test_some_wider_candidates_stay_and_some_go(spark):
    rng = random.Random(6)

    def card():
        d = "4" + "".join(rng.choices("0123456789", k=14))
        return d + next(c for c in "0123456789" if luhn(d + c))

    def phone():
        return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"

    def hexed():
        return "".join(rng.choices("abcdef", k=6)) + "".join(rng.choices("0123456789", k=9)) + "e"

    texts = []
    for i in range(150):
        texts += [f"call {phone()} now", f"card {card()} it is", f"token = {hexed()} end", f"order {rng.randint(10**8, 10**9)} came", f"version {i}.2.3.4.5.6 is out"]
    swallowed = [(phone(), card()) for _ in range(6)]
    texts += [f"there {p} {c} end" for p, c in swallowed]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.pii_digest(docs).collect()}
    for i, (p, c) in enumerate(swallowed, len(texts) - 6):
        assert f"phone_within:6:{6 + len(p)}" in rows[i]["spans"].split(",")
        assert f"card_within:{7 + len(p)}:{7 + len(p) + len(c)}" in rows[i]["spans"].split(",")
    kept = [s for i in range(len(texts) - 6) for s in rows[i]["spans"].split(",") if s]
    assert {s.split(":")[0] for s in kept} <= {"phone", "card", "ip"}
    found = [s for r in pii.candidates(docs).collect() for s in r["spans"]]
    assert sum(s["kind"] == "number" for s in found) >= 250


def test_long_runs_are_linear():
    text = "1" * 200_000 + " " + "a" * 200_000 + "." * 1000 + "@" * 1000 + "-" * 1000 + "+1" + "(" * 100_000
    assert pii.base_spans(text) == []
    assert pii.wider_spans(text, []) == []
