"""Personal data: base patterns, and a skip-chain conditional random field that adds to them.

The base patterns find emails, IP addresses, cards and phones. The field is trained
on a bounded sample of texts, labelled by these patterns and by assignments of
secrets (``token = "..."``); in each text the base spans are certain, and further
tokens become spans where their marginal probability is at least ``SURE``.

Training takes the ``SAMPLE`` texts with a digit, ``@`` or ``+`` that come first by a
hash of their id. It brings tokens, not texts, to the driver. Everything else works
on all rows and whole texts, text by text, without a shuffle.

Defined cases: a null or empty text has no spans. Nulls in the key are kept. Repeated
rows give the same spans each time. Without texts to train on, nothing is added.
Places are code points, the end exclusive. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.llm import crf
from lakejobs.llm.crf import KINDS, LABELS

# Runs are taken whole, with what follows if it fits: where it does not, no later start in
# the same run fits either, so each run is walked once.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"[0-9]++((?:\.[0-9]+){3})?")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Texts and tokens at most that the field is trained on.
SAMPLE, SAMPLE_TOKENS = 3_000, 200_000
SURE = 0.95

Span = tuple[str, int, int]


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind and place; matches that fail their test are dropped."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", *m.span()) for m in EMAIL.finditer(text) if m[1]]
    out += [("ip", *m.span()) for m in IP.finditer(text) if m[1] and all(int(x[-20:]) <= 255 and len(x.lstrip("0")) < 4 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and crf.luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _labelled(text: str) -> tuple[list[Span], list[crf.Token], dict[int, int]]:
    """Base spans, tokens, and the label of each token that lies in a span or is a secret."""
    base, found = base_spans(text), crf.tokens(text)
    marks = sorted((start, end, LABELS.index(kind)) for kind, start, end in base)
    marks += [(m.start(1), m.end(1), LABELS.index("secret")) for m in crf.SECRET.finditer(text)]
    marks.sort()
    certain, k = {}, 0
    for i, t in enumerate(found):
        while k < len(marks) and marks[k][1] <= t.start:
            k += 1
        over = [m for m in marks[k : k + 3] if m[0] < t.end and t.start < m[1]]
        if over:
            certain[i] = t.label = over[0][2]
    return base, found, certain


def _sample(batches):
    for batch in batches:
        rows = [_labelled(t or "")[1] for t in batch.column("text").to_pylist()]
        flat = [[(t.start, t.end, t.text, t.joined, t.features, t.label) for t in row] for row in rows]
        keys = ["start", "end", "text", "joined", "features", "label"]
        yield pa.RecordBatch.from_pylist([{"tokens": [dict(zip(keys, t)) for t in row]} for row in flat if row], SAMPLE_SCHEMA)


SAMPLE_SCHEMA = pa.schema([("tokens", pa.list_(pa.struct([
    ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("joined", pa.bool_()), ("features", pa.list_(pa.string())), ("label", pa.int64()),
])))])
SAMPLE_TYPE = "tokens array<struct<start:long,end:long,text:string,joined:boolean,features:array<string>,label:long>>"


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> crf.Model:
    """The field, trained on a bounded sample of the texts."""
    rows = docs.select(F.md5(F.coalesce(docs[key].cast("string"), F.lit(""))).alias("h"), docs[text].alias("text"))
    # A text longer than this is no sample; the model is applied to it all the same.
    rows = rows.filter(F.length("text") < 20_000).filter(F.col("text").rlike("[0-9@+]"))
    # Only texts whose hash is small enough to be among the first are sorted, or one task
    # would get as many of every other one.
    n = rows.count()
    if n > 2 * SAMPLE:
        rows = rows.filter(F.col("h") < f"{3 * SAMPLE * 2**32 // (2 * n):08x}")
    rows = rows.orderBy("h", "text").limit(SAMPLE)
    found, n = [], 0
    for row in rows.select("text").mapInArrow(_sample, SAMPLE_TYPE).toLocalIterator():
        if n < SAMPLE_TOKENS:
            found.append([crf.Token(**t.asDict()) for t in row["tokens"]])
            n += len(found[-1])
    return crf.train(found)


def all_spans(text: str, model: crf.Model) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind and place."""
    if not crf.ACTIVE.search(text):
        return [], []
    base, found, certain = _labelled(text)
    # Secrets are evidence, not spans yet: like the others they need their probability.
    more: list[Span] = []
    if any(LABELS[certain.get(i, 0)] not in KINDS for i in range(len(found))):
        taken = sorted((start, end) for _, start, end in base)
        for i, p in enumerate(model.marginals(found, certain)):
            label, t = int(p.argmax()), found[i]
            if label and p[label] >= SURE and (i not in certain or LABELS[label] == "secret"):
                if not any(a < t.end and t.start < b for a, b in taken):
                    old = more[-1] if more else None
                    if t.joined and old and old[0] == LABELS[label] and found[i - 1].end == old[2] and LABELS[label] == "phone":
                        more[-1] = (old[0], old[1], t.end)
                    else:
                        more.append((LABELS[label], t.start, t.end))
    order = {kind: i for i, kind in enumerate(LABELS[1:])}
    return base, sorted(base + more, key=lambda s: (order[s[0]], s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find(docs: DataFrame, model: crf.Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for value in batch.column("text"):
                base, every = all_spans(value.as_py() or "", shared.value)
                for c, kind in zip(columns, KINDS):
                    c.append(sum(s[0] == kind for s in base))
                columns[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                columns[5].append(joined(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]],
                ["key", *[f"n_{kind}" for kind in KINDS], "base_sha256", "spans"],
            )

    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"key long, {counts}, base_sha256 string, spans string")
