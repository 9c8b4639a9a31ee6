"""Personal data: base patterns, and further spans chosen by boosted trees among candidates. DataFrame functions only; no shuffle.

Base spans (email, ip, card, phone) follow fixed patterns with fixed filters. For further spans, high-recall generators propose
candidates that may overlap each other and base spans: secrets (assignments to a word such as token or password, bearer tokens,
keys with a vendor's prefix, signed tokens of three parts, private key blocks), written-out addresses ("name at host dot com"),
long numbers, and grouped numbers. Features of a candidate's form and of the text before it go through boosted trees, trained on
the driver from labelled examples that `examples` makes from templates, in which neither a cue word nor a form alone decides; a
candidate whose calibrated probability reaches THRESHOLD of its kind is a span. Positions are code points, end exclusive.

The trees are compared as expressions inside the JVM. Patterns are possessive, so that matching is linear and does not recurse.
A null text counts as empty: no spans. A text of any length is matched whole. Rows are independent; repeated rows give repeated
results; of spans that begin together the longest is redacted, and of equal ones that of the first kind. An empty table gives no
rows. Extra columns are kept by `redacted`, whatever their names, and not read by `found`.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm import boosting
from cloudloom.llm.common import table, unused

#: Fixed patterns; possessive where a greedy run can never give anything back. After a match the next may start inside a run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain to be matched at all.
NEEDED = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Vendors' prefixes of keys.
PREFIXES = "sk pk rk ghp gho ghs ghu ghr github_pat glpat xoxa xoxb xoxp xoxr xoxs npm pypi shpat hf akia asia aiza ya29".split()
GENERATED = {
    "secret": r"(?i)(?<![a-z0-9])(?<![a-z0-9][_-])(?:[a-z0-9]++[_-])*+(?:token|secret|apikey|key|password|passwd|pwd|credential|auth)s?\s{0,3}[=:]\s{0,3}[\"']?[^\s\"',;<>]{4,}+[\"']?"
    r"|(?<![a-z0-9])bearer\s{1,3}[a-z0-9._~+/=-]{8,}+|(?<![a-z0-9_-])eyj[a-z0-9_-]{8,}+\.[a-z0-9_-]{4,}+(?:\.[a-z0-9_-]*+)?"
    rf"|(?<![a-z0-9_-])(?:{'|'.join(PREFIXES)})[_-]?[a-z0-9_-]{{12,}}+|-----begin [a-z0-9 ]{{0,40}}key-----[^-]*+(?:-----end [a-z0-9 ]{{0,40}}key-----)?",
    "address": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\s{0,3}[\[(]?\s{0,3}(?:\bat\b|@)\s{0,3}[\])]?\s{0,3}[a-z0-9-]++\s{0,3}[\[(]?\s{0,3}(?:\bdot\b)\s{0,3}[\])]?\s{0,3}[a-z]{2,24}+",
    "number": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){8,}+",
    "group": r"(?<![0-9])[(]?[0-9]{2,4}[)]?[\x20.-][0-9]{2,4}[\x20.-][0-9]{2,6}(?![0-9])",
}
GENERATED_NEEDED = {
    "secret": rf"(?i)(?:token|secret|key|passw|pwd|credential|auth)[a-z]?\s{{0,3}}[=:]|bearer\s|eyj[a-z0-9_-]{{8}}|key-----|(?<![a-z0-9_-])(?:{'|'.join(PREFIXES)})[_-]?[a-z0-9_-]{{12}}",
    "address": r"(?i)(?<![a-z])dot(?![a-z])", "number": r"[0-9](?:[\x20.-]?[0-9]){8}", "group": r"[0-9][)]?[\x20.-][0-9]{2,4}[\x20.-][0-9]",
}
KINDS = [*BASE, *GENERATED]
THRESHOLD = {"secret": 0.5, "address": 0.5, "number": 0.8, "group": 0.8}
BLOCK, BEFORE = 256, 32
#: Texts with more spans to redact than this are cut into their characters once; the others are cut at each span.
MANY = 64
CUES = r"(?i)(?:call|phone|tel|mobile|fax|cell|card|visa|account|iban|acct|ssn|social security|passport|license no|id no|contact|e-?mail|number|reach)[^0-9]{0,14}$"
COUNTS = r"(?i)(?:[$€£#]|\b(?:page|pages|version|v|since|year|in|on|of|from|chapter|section|isbn|order|total|about|part|model|score|over))[^0-9a-z]{0,4}$"
MASK = "[{}]"


def spans_of(text: Column, pattern: str, needed: str, tail: int = 0) -> Column:
    """Array of (start, end, match, before) of the matches. Lengths of pieces are summed by blocks, so work is linear but for BLOCK."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.named_struct(F.lit("p"), F.transform(parts, lambda s: F.length(s)), F.lit("m"), found, F.lit("t"), F.transform(parts, lambda s: F.right(s, F.lit(tail))) if tail else F.lit(None))

    def placed(x: Column) -> Column:
        sizes = F.transform(x["m"], lambda s, i: F.element_at(x["p"], i + 1) + F.length(s))
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(x["m"]) - 1) / BLOCK).cast("int")), lambda k: F.aggregate(F.slice(sizes, k * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, b: a + b))
        y = F.named_struct(F.lit("x"), x, F.lit("sizes"), sizes, F.lit("sums"), sums)

        def one(y: Column) -> Column:
            def at(s: Column, i: Column) -> Column:
                k = F.floor(i / BLOCK).cast("int")
                start = F.aggregate(F.slice(y["sums"], F.lit(1), k), F.lit(0), lambda a, b: a + b) + F.aggregate(F.slice(y["sizes"], k * BLOCK + 1, i - k * BLOCK), F.lit(0), lambda a, b: a + b) + F.element_at(y["x"]["p"], i + 1)
                before = F.element_at(y["x"]["t"], i + 1) if tail else F.lit(None).cast("string")
                return F.named_struct(F.lit("start"), start, F.lit("end"), start + F.length(s), F.lit("match"), s, F.lit("before"), before)

            return F.transform(y["x"]["m"], at)

        return F.element_at(F.transform(F.array(y), one), 1)

    placed_ = F.element_at(F.transform(F.array(both), lambda x: F.when(F.size(x["m"]) > 0, placed(x))), 1)
    return F.coalesce(F.when(F.rlike(text, F.lit(needed)), placed_), F.array().cast("array<struct<start:int,end:int,match:string,before:string>>"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: each second one from the right is doubled."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


KEEPS = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.rlike(s, F.lit(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")),
    "card": lambda s: F.when(F.length(digits(s)).between(16, 19), luhn(digits(s))).otherwise(False),
    "phone": lambda s: F.length(digits(s)).between(8, 15),
}

#: Features of a candidate: name, as a column of its match and the text before it, as a function of the same strings.
_length = lambda pattern: (lambda s, b: F.length(F.regexp_replace(s, pattern, "")).cast("double"), lambda s, b: float(len(re.sub(pattern, "", s))))
_group = lambda pattern: (lambda s, b: F.length(F.regexp_extract(s, pattern, 1)).cast("double"), lambda s, b: float(len(m[1])) if (m := re.search(pattern, s)) else 0.0)
_has = lambda pattern: (lambda s, b: F.rlike(s, F.lit(pattern)).cast("double"), lambda s, b: float(bool(re.search(pattern, s))))
_before = lambda pattern: (lambda s, b: F.rlike(b, F.lit(pattern)).cast("double"), lambda s, b: float(bool(re.search(pattern, b))))
_VALUE = r"^[^=:]*+[=:]\s*+"
_value = lambda pattern: (
    lambda s, b: F.length(F.regexp_replace(F.regexp_replace(s, _VALUE, ""), pattern, "")).cast("double"), lambda s, b: float(len(re.sub(pattern, "", re.sub(_VALUE, "", s)))))
_share = (lambda s, b: F.length(digits(s)).cast("double") / F.greatest(F.length(s), F.lit(1)), lambda s, b: len(re.sub("[^0-9]", "", s)) / max(1, len(s)))
FEATURES = [
    ("length", *_length("(?!)")), ("digit share", *_share), ("digits", *_length("[^0-9]")), ("separators", *_length("[^ .()-]")),
    ("first run", *_group("([0-9]++)")), ("second run", *_group("^[^0-9]*+[0-9]++[^0-9]++([0-9]++)")), ("last run", *_group("(?<![0-9])([0-9]++)[^0-9]*+$")),
    ("spaces", *_length("[^ ]")), ("dots", *_length("[^.]")), ("hyphens", *_length("[^-]")),
    ("digits of value", *_value("[^0-9]")), ("length of value", *_value("(?!)")), ("capitals of value", *_value("[^A-Z]")), ("marks of value", *_value("[A-Za-z0-9]")),
    ("quoted", *_has("[\"']")), ("bracketed", *_has(r"[\[(]")), ("known form", *_has(rf"^(?i:bearer |eyj|-----begin|(?:{'|'.join(PREFIXES)})[_-])")),
    ("cue before", *_before(CUES)), ("count before", *_before(COUNTS)), ("starts year", *_has("^(?:19|20)[0-9]{2}[^0-9]")), ("ends year", *_has("[^0-9](?:19|20)[0-9]{2}$")), ("known ending", *_has("(?i)(?:com|org|net|edu|io|gov)$")), ("last word", *_group("(?<![A-Za-z])([A-Za-z]++)$")),
]


def examples(kind: str, n: int = 900, seed: int = 11) -> tuple[list[tuple[str, str]], list[int]]:
    """(match, text before) and label of n made-up candidates of a kind. Cues stand before good and bad ones, and forms are of both where context must decide."""
    r, rows, labels = random.Random(f"{kind}{seed}"), [], []
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda k: "".join(r.choice("abcdefghijklmnoprstuvwy") for _ in range(k))
    of = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    hexed = lambda k: of("0123456789abcdef", k)
    mixed = lambda k: of("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789_-", k)
    prose = lambda: " ".join(w(r.randint(2, 8)) for _ in range(4)) + r.choice([" ", ". ", ", "])
    cue = lambda: prose() + r.choice(["call ", "phone: ", "card no. ", "account ", "SSN ", "tel. ", "my number is ", "his number ", "reach me on ", "contact: ", "fax "])
    count = lambda: prose() + r.choice(["page ", "version ", "since ", "order ", "total ", "$", "€", "ISBN ", "section ", "about ", "model ", "in ", "part "])
    year = lambda: r.choice(["19", "20"]) + d(2)
    for i in range(n):
        good, before = i % 2 == 0, prose()
        if kind == "secret":
            name, mark = r.choice(["token", "secret", "api_key", "password", "auth", "key", "pwd"]), r.choice([" = ", "=", ": ", ":"])
            q = r.choice(['"', '"', "'", ""])
            long = r.choice([mixed(r.randint(100, 1500)), hexed(r.randint(100, 1500)), ".".join(mixed(r.randint(30, 600)) for _ in range(3))]) + r.choice(["", "", "=", "=="])
            value = r.choice([hexed(r.randint(16, 64)), mixed(r.randint(12, 60)), w(4) + d(4), w(r.randint(5, 8)).title() + r.choice("!?#*") + d(2), long])
            block = f"-----BEGIN {r.choice(['', 'RSA ', 'EC '])}PRIVATE KEY-----\n{mixed(r.randint(60, 600))}\n-----END PRIVATE KEY-----"
            own = r.choice([f"Bearer {mixed(r.randint(16, 200))}", f"eyJ{mixed(30)}.{mixed(60)}.{mixed(40)}", f"{r.choice(PREFIXES)}{r.choice('_-')}{mixed(r.randint(16, 80))}", f"AKIA{of('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 16)}", block])
            word = r.choice([w(r.randint(4, 12)), w(r.randint(4, 9)).title(), f"{w(4)}-{w(5)}", f"{w(5)}()", d(r.randint(4, 6)) if name == "key" else w(6), year()])
            bad = r.choice([f"{name}: {word}", f"{name} = {word}", f'{name}: "{word}"', f"bearer {w(r.randint(8, 12))}", f"{r.choice(['sk', 'pk', 'hf', 'npm'])}{w(r.randint(12, 20))}", f"{r.choice(['sk', 'npm', 'hf'])}-{w(6)}-{w(7)}"])
            match = r.choice([f"{name}{mark}{q}{value}{q}", f"{name}{mark}{q}{value}{q}", own]) if good else bad
        elif kind == "address":
            host, known, other = w(r.randint(3, 9)), r.choice(["com", "org", "net", "io", "edu"]), r.choice(["de", "fr", "co", "info", "nl", "uk"])
            end = r.choice([known, other])
            good_form = [f"{w(6)} [at] {host} [dot] {end}", f"{w(4)}{d(2)} (at) {host} (dot) {end}", f"{w(5)}.{w(6)} at {host} dot {known}", f"{w(5)}@{host} dot {end}", f"{w(6)} at {host} dot {known}"]
            bad_form = [f"{w(r.randint(1, 6))} at {host} dot {w(r.randint(5, 9))}", f"{w(3)} (at) {w(3)} (dot) {w(r.randint(6, 9))}", f"{w(7)} @ {host} dot {w(6)}", f"{w(4)} at {host} dot {w(r.randint(2, 4))}"]
            match = r.choice(good_form if good else bad_form)
        elif kind == "number":
            plain = lambda: d(r.randint(9, 19))
            if good:
                form = r.choice(["plain", "plain", "4444", "3-3-4", "3-2-4"])
                match = {"plain": plain(), "4444": f"{d(4)} {d(4)} {d(4)} {d(4)}", "3-3-4": f"{d(3)}-{d(3)}-{d(4)}", "3-2-4": f"{d(3)}-{d(2)}-{d(4)}"}[form]
                before = cue() if form == "plain" or r.random() < 0.5 else before
            else:
                form = r.choice(["plain", "thousands", "long", "date", "cued thousands", "cued date", "isbn"])
                thousands, date = " ".join([d(r.randint(1, 3)), *[d(3) for _ in range(r.randint(3, 4))]]), r.choice([f"{year()}-{d(2)}-{d(2)} {d(2)}", f"{d(2)}.{d(2)}.{year()} {d(2)}"])
                match = {"plain": plain(), "thousands": thousands, "long": d(r.randint(24, 60)), "date": date, "cued thousands": thousands, "cued date": date, "isbn": f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"}[form]
                before = cue() if form.startswith("cued") else count() if r.random() < 0.5 else before
        else:
            if good:
                form = r.choice(["(3) 3-4", "3-2-4", "3.3.4", "3 3 4", "3-3-4"])
                match = {"(3) 3-4": f"({d(3)}) {d(3)}-{d(4)}", "3-2-4": f"{d(3)}-{d(2)}-{d(4)}", "3.3.4": f"{d(3)}.{d(3)}.{d(4)}", "3 3 4": f"{d(3)} {d(3)} {d(4)}", "3-3-4": f"{d(3)}-{d(3)}-{d(4)}"}[form]
                before = cue() if form == "3 3 4" or r.random() < 0.5 else before
            else:
                form = r.choice(["ymd", "dmy", "thousands", "short", "3 3 4"])
                match = {"ymd": f"{year()}-{d(2)}-{d(2)}", "dmy": f"{d(2)}{r.choice('.-')}{d(2)}-{year()}", "thousands": f"{d(3)} {d(3)} {d(3)}", "short": f"{d(2)}.{d(2)}.{d(2)}", "3 3 4": f"{d(3)} {d(3)} {d(4)}"}[form]
                before = (cue() if r.random() < 0.4 else count() if r.random() < 0.5 else before) if form != "3 3 4" else count()
        rows.append((match, before[-BEFORE:]))
        labels.append(int(good))
    return rows, labels


@functools.cache
def model(kind: str) -> boosting.Boosted:
    rows, labels = examples(kind)
    x = np.array([[f(s, b) for _, _, f in FEATURES] for s, b in rows], float)
    return boosting.fit(x, np.array(labels))


def _kept(kind: str):
    return lambda c: KEEPS[kind](c["match"])


def accepted(kind: str):
    """Condition on a candidate of the kind, as a function of it. Its features are made once and bound, as the trees ask for them again and again."""

    def condition(c: Column) -> Column:
        made = F.struct(*[f(c["match"], c["before"]).alias(f"f{k}") for k, (_, f, _) in enumerate(FEATURES)])
        chosen = F.transform(F.array(made), lambda x: model(kind).probability_column([x[f"f{k}"] for k in range(len(FEATURES))]) >= F.lit(THRESHOLD[kind]))
        return F.element_at(chosen, 1)

    return condition


def spans(text: Column) -> Column:
    """A struct with, for each kind of KINDS, an array of (start, end)."""
    at = F.coalesce(text, F.lit(""))
    kinds = []
    for kind in BASE:
        kinds.append(F.filter(spans_of(at, BASE[kind], NEEDED[kind]), _kept(kind)))
    for kind in GENERATED:
        kinds.append(F.filter(spans_of(at, GENERATED[kind], GENERATED_NEEDED[kind], BEFORE), accepted(kind)))
    slim = [F.transform(k, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))) for k in kinds]
    return F.struct(*[s.alias(k) for k, s in zip(KINDS, slim, strict=True)])


def with_spans(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the spans of its text in a column of that name, which df must not have."""
    return df.withColumn(name, spans(F.col(f"`{text}`")))


def listed(at: Column, kinds: list[str]) -> Column:
    def of(kind: str) -> Column:
        return F.transform(at[kind], lambda c: F.concat_ws(":", F.lit(kind), c["start"].cast("string"), c["end"].cast("string")))

    return F.array_join(F.concat(*map(of, kinds)), ",")


def found(df: DataFrame) -> DataFrame:
    """doc_id, counts of all kinds, base_sha256 and spans for each row."""
    at = F.col("found")
    counts = {k: F.size(at[k]).cast("long").alias(f"n_{k}") for k in KINDS}
    rows = with_spans(df.select("doc_id", "text"), "text", "found")
    return rows.select("doc_id", *[counts[k] for k in BASE], F.sha2(listed(at, [*BASE]).cast("binary"), 256).alias("base_sha256"), listed(at, KINDS).alias("spans"), *[counts[k] for k in GENERATED])


def cleared(text: Column, at: Column) -> Column:
    """The text with its spans replaced by their kinds. A span begins a replacement if no span before it reaches it; work is linear but for BLOCK."""

    def masked(kind: str) -> Column:
        return F.transform(at[kind], lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("less"), F.lit(KINDS.index(kind)).alias("kind"), F.lit(MASK.format(kind.upper())).alias("mask")))

    def first(x: Column) -> Column:
        ends = F.transform(x["s"], lambda c: -c["less"])
        most = F.transform(F.sequence(F.lit(0), F.floor((F.size(x["s"]) - 1) / BLOCK).cast("int")), lambda k: F.array_max(F.slice(ends, k * BLOCK + 1, F.lit(BLOCK))))
        return F.struct(x["t"].alias("t"), x["s"].alias("s"), ends.alias("ends"), most.alias("most"), F.when(F.size(x["s"]) > MANY, F.split(x["t"], "", -1)).alias("chars"))

    def second(x: Column) -> Column:
        def placed(c: Column, i: Column) -> Column:
            k = F.floor(i / BLOCK).cast("int")
            before = F.greatest(F.lit(0), F.array_max(F.slice(x["most"], F.lit(1), k)), F.array_max(F.slice(x["ends"], k * BLOCK + 1, i - k * BLOCK)))
            return F.struct(c["start"].alias("start"), before.alias("from"), c["mask"].alias("mask"))

        def part(begin: Column, length: Column) -> Column:
            return F.when(x["chars"].isNull(), F.substring(x["t"], begin + 1, length)).otherwise(F.array_join(F.slice(x["chars"], begin + 1, length), ""))

        begun = F.filter(F.transform(x["s"], placed), lambda h: h["start"] >= h["from"])
        pieces = F.transform(begun, lambda h: F.concat(part(h["from"], h["start"] - h["from"]), h["mask"]))
        last = F.array_max(x["ends"])
        return F.concat(F.array_join(pieces, ""), part(last, F.length(x["t"]) - last))

    every = F.array_sort(F.concat(*map(masked, KINDS)))
    bound = F.transform(F.transform(F.array(F.struct(text.alias("t"), every.alias("s"))), lambda x: F.when(F.size(x["s"]) > 0, first(x))), lambda x: second(x))
    return F.coalesce(F.element_at(bound, 1), text)


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every span of its text replaced by the span's kind in brackets; spans that overlap are replaced together by the first one's. A null text stays null; n_chars, if there, follows the text."""
    name = unused(df, "spans")
    out = with_spans(df, text, name).withColumn(text, cleared(F.col(f"`{text}`"), F.col(name)))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length(F.col(f"`{text}`")).cast(df.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in df.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "documents"))
