"""Personal data by weak supervision.

Candidates are the spans of the base patterns and of wider ones: numbers without a plus sign, telephone and card numbers
in a run of digits that a base pattern takes whole and drops, spelled-out addresses, account numbers, and what looks
like personal data and mostly isn't, as versions, plain numbers and digits inside keys. Labelers vote on each: the
pattern, its structure (check sums, ranges), a gazetteer, words before it for and against, and its surroundings.
Expectation-maximisation over the counts of vote patterns in the whole corpus estimates, for each group of kinds by
itself, each labeler's reliability and the share of true spans; a logistic span classifier is then trained on those
probabilities and on features of the span. Base spans always stay; a wider candidate stays if the classifier gives at
least 0.5.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import arrow, staged, text_bytes
from surveyloom.llm.secretscan import digest_columns

BASE = ("email", "ip", "card", "phone")
#: Wider kinds in the order in which they are looked for, each with the group that its labelers are judged in. What
#: overlaps a base span or one that was found before it isn't a candidate.
WIDER_GROUPS = {
    "phone_within": "phone", "card_within": "card", "phone_local": "phone", "email_spelled": "email", "iban": "iban", "ssn": "ssn",
    "ip_like": "ip", "email_like": "email", "number": "phone",
}
GROUPS = {k: k for k in BASE} | WIDER_GROUPS
KINDS = tuple(GROUPS)
#: Kinds that mostly aren't personal data: their pattern speaks against them.
UNLIKELY = ("ip_like", "email_like", "number")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WIDER = {
    "phone_local": re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])"),
    "email_spelled": re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}(?:\x20at\x20|\x20?\[at\]\x20?|\x20?\(at\)\x20?)[A-Za-z0-9-]{1,64}(?:\x20dot\x20|\x20?\[dot\]\x20?|\x20?\(dot\)\x20?)[A-Za-z]{2,24}(?![A-Za-z])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "phone_within": re.compile(r"(?<![0-9+])\+[0-9]{1,3}\x20?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])"),
    "card_within": re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9A-Za-z])"),
    "ip_like": re.compile(r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3,}+"),
    "email_like": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?![A-Za-z0-9.-])"),
    "number": re.compile(r"(?<![0-9])[0-9]{7,19}(?![0-9])"),
}

# Common top-level domains, country calling codes, IBAN countries, and words that stand before such data.
DOMAINS = frozenset("com org net edu gov mil int info biz io co de fr es it uk us eu nl be ch at se no dk fi pl pt ie cz ru cn jp in br mx ca au".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "98", "351", "352", "353", "358", "420", "421")
IBANS = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split())
NEAR = {
    "email": "mail email e-mail contact write correo courriel kontakt",
    "ip": "ip host server address addr login from client",
    "card": "card visa mastercard amex credit payment pay tarjeta carte karte",
    "phone": "phone tel call fax mobile cell telephone telefon teléfono téléphone contact",
    "iban": "iban account bank konto compte cuenta transfer",
    "ssn": "ssn social security taxpayer tax",
}
CONTEXT = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, v.split())) + r")(?!\w)", re.I) for k, v in NEAR.items()}
OTHERWISE = re.compile(r"(?<!\w)(?:version|release|isbn|order|invoice|page|figure|section|serial|ratio|score|article|no|nr|id|token|secret|password|passwd|api_?key)(?!\w)", re.I)
WINDOW = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to the left over the run of local characters: linear where a scan from the left is quadratic."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """A chain of numbers joined by dots is taken four by four."""
    for m in CHAIN.finditer(text):
        at, group = m.start(), m.group().split(".")
        for i in range(0, len(group) - 3, 4):
            four = group[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                yield at, at + size
            at += size + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40 and 12 <= len(d := re.sub(r"[\x20-]", "", m.group())) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            yield m.span()


FIND = dict(zip(BASE, (emails, addresses, cards, phones), strict=True))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, ordered."""
    digits = re.search("[0-9]", text) is not None
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if digits:
        for k in (1, 2, 3):
            found += ((a, k, b) for a, b in FIND[BASE[k]](text))
    return sorted(found)


def wider_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the wider patterns, ordered; none touches a base span or another."""
    digits, at = re.search("[0-9]{4}|[0-9][.][0-9]", text) is not None, "@" in text
    found: list[tuple[int, int, int]] = []
    apart: list[tuple[int, int]] = []  # what is taken, united, ascending
    for a, _, b in taken:
        if apart and a < apart[-1][1]:
            apart[-1] = (apart[-1][0], max(apart[-1][1], b))
        else:
            apart.append((a, b))
    for k in range(len(BASE), len(KINDS)):
        kind = KINDS[k]
        if not {"email_spelled": "dot" in text, "email_like": at}.get(kind, digits):
            continue
        starts, free = [a for a, _ in apart], []
        for m in WIDER[kind].finditer(text):
            i = bisect_left(starts, m.end()) - 1
            if i < 0 or apart[i][1] <= m.start():
                free.append(m.span())
        if free:
            found += ((a, k, b) for a, b in free)
            apart = sorted(apart + free)
    return sorted(found)


def structure(kind: str, value: str) -> int:
    digits, group = re.sub("[^0-9]", "", value), GROUPS[kind]
    if group == "card":
        return 1 if luhn(digits) and digits[:1] in "3456" else -1
    if group == "ip":
        parts = value.split(".")
        return 1 if len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 and (x == "0" or x[0] != "0") for x in parts) and parts[0] != "0" else -1
    if kind == "phone_local":
        return 1 if digits[0] in "23456789" and digits[3] in "23456789" else -1
    if kind == "number":
        return 0 if len(digits) == 10 and digits[0] in "23456789" and digits[3] in "23456789" else -1
    if group == "phone":
        return 1 if 10 <= len(digits) <= 13 else -1
    if kind == "iban":
        moved = value[4:] + value[:4]
        return 1 if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 else -1
    if kind == "ssn":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    return 1 if len(value) <= 100 and not re.search(r"\.\.|^[.-]", value) else -1


def gazetteer(kind: str, value: str) -> int:
    group = GROUPS[kind]
    if group == "email":
        return 1 if kind != "email_like" and re.split("[^A-Za-z]", value)[-1].lower() in DOMAINS else -1
    if group == "phone":
        return 0 if value[:1] != "+" else 1 if re.sub("[^0-9]", "", value).startswith(CALLING) else -1
    if group == "iban":
        return 1 if value[:2] in IBANS else -1
    if group == "ip":
        return 1 if value.startswith(("10.", "192.168.", "127.", "172.")) else 0
    return 0


def votes(kind: str, text: str, a: int, b: int) -> tuple[int, ...]:
    """Of the labelers, in order: pattern, structure, gazetteer, words for, words against, surroundings."""
    value, before = text[a:b], text[max(0, a - WINDOW) : a]
    left, right = text[a - 1 : a], text[b : b + 1]
    return (
        1 if kind in BASE else -1 if kind in UNLIKELY else 0,
        structure(kind, value),
        gazetteer(kind, value),
        1 if CONTEXT[GROUPS[kind]].search(before) else 0,
        -1 if OTHERWISE.search(before) else 0,
        -1 if (left and (left in "./-_=#" or (left.isalnum() and left.isascii())) and value[:1] != "+") or (right and (right.isalnum() or right in "/_=")) else 1,
    )


def key_of(kind: str, text: str, a: int, b: int) -> str:
    """What the classifier sees of a span: kind, votes, length and the character before, in few classes."""
    left = text[a - 1 : a]
    around = "s" if not left or left.isspace() else "p" if not left.isalnum() else "w"
    return "|".join((kind, ",".join(map(str, votes(kind, text, a, b))), str(min((b - a) // 8, 4)), around))


def vote_model(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM for two classes and labelers that err independently, over counted vote patterns; one that abstains says nothing.
    Returns each pattern's probability of a true span, and by labeler the probability of votes (-1, 0, 1) given a
    false and a true span and that it votes. Add-one smoothing keeps all finite; it begins from the mean vote."""
    v = np.array([p for p, _ in patterns], dtype=np.int64) + 1
    n = np.array([c for _, c in patterns], dtype=np.float64)
    post = 1 / (1 + np.exp(-(v - 1).sum(1) * 1.0))
    table = np.zeros((v.shape[1], 2, 3))
    for _ in range(rounds):
        for j in range(v.shape[1]):
            for c, w in enumerate((n * (1 - post), n * post)):
                table[j, c] = np.bincount(v[:, j], weights=w, minlength=3) + 1
        table[:, :, 1] = 0
        table /= table.sum(2, keepdims=True)
        told = np.log(table + (table == 0))  # of an abstention nothing
        prior = (np.sum(n * post) + 1) / (n.sum() + 2)
        log = np.log([1 - prior, prior])[None] + sum(told[j][:, v[:, j]].T for j in range(v.shape[1]))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, table


def span_classifier(keys: list[str], counts: list[int], soft: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Logistic regression on one-hot parts of the keys, weighted by counts, towards EM's probabilities; its own
    probability of each key. A little decay keeps the weights of rare parts small."""
    names: dict[str, int] = {}
    rows = []
    for key in keys:
        kind, vote, size, around = key.split("|")
        parts = [kind, f"{kind}{size}", f"{kind}{around}", *(f"{GROUPS[kind]}{j}{x}" for j, x in enumerate(vote.split(",")))]
        rows.append([names.setdefault(p, len(names)) for p in parts])
    x = np.zeros((len(keys), len(names) + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, r] = 1
    w, c = np.zeros(x.shape[1]), np.array(counts, dtype=np.float64) ** 0.5
    c /= c.sum()
    for _ in range(rounds):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (c * (p - soft)) + 1e-4 * w
        h = (x * (c * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-x @ w))


SPAN = "array<struct<kind:string,start:int,end:int,base:boolean,key:string>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) with every base span and wider candidate, its votes and features in key."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("key", pa.string())]))
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                out = []
                for raw in part.column(1):
                    text = raw.as_py().decode("utf-8", "replace")
                    base = base_spans(text)
                    both = sorted([(a, k, b, True) for a, k, b in base] + [(a, k, b, False) for a, k, b in wider_spans(text, base)])
                    out.append([{"kind": KINDS[k], "start": a, "end": b, "base": is_base, "key": key_of(KINDS[k], text, a, b)} for a, k, b, is_base in both])
                yield arrow({"doc_id": (part.column(0).to_pylist(), pa.int64()), "spans": (out, kind)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col)).mapInArrow(scan, f"doc_id long, spans {SPAN}")


def label_model(found: DataFrame) -> dict[str, float]:
    """Probability of a true span by key. Only counts of keys come to the driver; their number is bounded by the
    classes of the parts (13 kinds, 2 to 3 votes of 6 labelers, 5 sizes, 3 surroundings), not by the corpus."""
    rows = found.select(F.explode("spans.key").alias("key")).groupBy("key").count().orderBy("key").collect()
    if not rows:
        return {}
    keys, counts = [r["key"] for r in rows], [r["count"] for r in rows]
    return dict(zip(keys, span_classifier(keys, counts, soft_labels(keys, counts)).tolist(), strict=True))


def soft_labels(keys: list[str], counts: list[int]) -> np.ndarray:
    """EM's probability of a true span for each key: a model for each group of kinds."""
    group = [GROUPS[k.split("|")[0]] for k in keys]
    vote = [tuple(map(int, k.split("|")[1].split(","))) for k in keys]
    out = np.zeros(len(keys))
    for g in sorted(set(group)):
        at = [i for i, x in enumerate(group) if x == g]
        patterns: dict[tuple[int, ...], int] = {}
        for i in at:
            patterns[vote[i]] = patterns.get(vote[i], 0) + counts[i]
        post = dict(zip(patterns, vote_model(list(patterns.items()))[0], strict=True))
        out[at] = [post[vote[i]] for i in at]
    return out


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, probability>>), one row for each row of docs.

    Offsets are code points, ends exclusive; order is start, then kind as in KINDS. A null or empty text has no
    spans, a null id stays null, repeated rows are repeated, an empty table gives no rows; other columns are not
    read. The text is read once: its candidates, a few bytes a span, are staged in the shared folder.
    """
    found = staged(candidates(docs, id_col, text_col), "pii")
    model = label_model(found)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": s["kind"], "start": s["start"], "end": s["end"], "probability": p} for s in x if (p := model[s["key"]]) >= least or s["base"]] for x in batch.column(1).to_pylist()]
            yield arrow({"doc_id": (batch.column(0), pa.int64()), "spans": (spans, kind)})

    return found.mapInArrow(keep, "doc_id long, spans array<struct<kind:string,start:int,end:int,probability:double>>")


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    return digest_columns(scan_pii(docs), BASE, {k: f"n_{k}" for k in BASE})


__all__ = ["base_spans", "candidates", "label_model", "pii_digest", "scan_pii", "span_classifier", "vote_model", "wider_spans"]
