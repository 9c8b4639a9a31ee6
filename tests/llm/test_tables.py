"""Every operator over awkward tables: none, nulls, empty and very long texts, repeated rows, ties, extra columns with the operators' own names; and chat against a plain version."""

import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from cloudloom.llm import bpe, chat, exact_dedup, html, language, lm, media, neardup, packing, pii

#: Names that operators use inside.
CLASHING = "spans __spans found file row key bucket block label digest norm n root node a b size held i j class_id keeper rows text_sha256 path score bands bag doubt id corners __file __row mark_bucket marks".split()
LONG = " ".join(f"word{k % 9000} goes" for k in range(60_000)) + " mail a@b.cd"
TEXTS = [None, "", " \n\t", "a", "a", "The same text twice, of more than five words in all.", "The same text twice, of more than five words in all.", "1 2 3", LONG, LONG]


def table(spark, texts=TEXTS, ids=None):
    ids = ids or [*range(len(texts) - 1), None]
    rows = [(i, t, "fr" if "word" in (t or "") else "en", "s", len(t or ""), *["x"] * len(CLASHING)) for i, t in zip(ids, texts, strict=True)]
    rows.append(rows[5])  # a row repeated whole
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))


def scored(df):
    rows, blocks = lm.marked(df, df.sparkSession.createDataFrame([(5, 1, "x"), (None, 1, "x")], "doc_id long, quality int, block string"))
    return lm.losses(rows, lm.sums(lm.counts(rows, lm.buckets_of(blocks))))


ROWS = {  # one row for each row
    "classes": neardup.classes, "pii": pii.found, "redacted": pii.redacted, "bpe": lambda df: bpe.digests(df, public_tokenizers.path("byte_bpe_50k.json")),
    "language": lambda df: language.predict(df, language.train(df)), "scores": scored,
}
SOME = {"dedup": exact_dedup.dedup, "near": neardup.dedup, "accepted": lambda df: language.accepted(df, language.train(df)), "packed": lambda df: packing.packed(df, public_tokenizers.path("word_bpe_49k.json"))}


@pytest.mark.parametrize("name", [*ROWS, *SOME])
def test_awkward_tables(spark, name):
    run, df = {**ROWS, **SOME}[name], table(spark)
    out = run(df)
    got = out.toPandas()
    assert run(df.where("false")).count() == 0
    if name in ROWS:
        assert len(got) == len(TEXTS) + 1
    if name in ("redacted", "dedup", "near", "accepted"):
        assert out.columns == df.columns and all((got[c] == "x").all() for c in CLASHING)
    if name in ROWS:  # copies, and the row repeated, get the same
        plain = [tuple(str(v) for c, v in r.items() if c not in ("doc_id", "class_id")) for r in got[got.doc_id.isin([5, 6])].to_dict("records")]
        assert len(plain) == 3 and (len(set(plain)) == 1 or name == "scores")  # one of them is target
    if name == "classes":
        named = {int(r.doc_id): int(r.class_id) for r in got.itertuples() if r.doc_id == r.doc_id}
        assert named == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 8} and got[got.doc_id.isna()].class_id.isna().all()
    if name == "dedup":
        assert sorted(got.doc_id.fillna(-1)) == [1, 3, 5, 7, 8] or sorted(got.doc_id.fillna(-1)) == [2, 3, 5, 7, 8]
    if name == "accepted":
        assert sorted(got.doc_id.fillna(-1)) == [-1, 3, 4, 5, 5, 6, 8]
    if name == "packed":
        assert got.groupby("sequence_id").length.sum().le(2048).all() and got.length.sum() == got.drop_duplicates(["doc_id", "doc_tokens"]).doc_tokens.sum() + got[got.doc_id == 5].drop_duplicates("doc_id").doc_tokens.sum()
    if name == "redacted":
        assert got[got.doc_id == 8].text.iloc[0].endswith("mail [EMAIL]") and (got.n_chars == got.text.fillna("").str.len()).where(got.text.notna(), True).all()


@pytest.mark.parametrize("k", [1, 2, 3, 5, 9])
def test_language_decodes_as_brute_force(k):
    """The codeword of the least weighted loss, one by one."""
    r = np.random.default_rng(k)
    code = language.codewords(k)
    bits = code.shape[1]
    model = language.Model([f"l{i}" for i in range(k)], code, r.normal(size=(language.CELLS, bits)) * 4, r.normal(size=bits), r.uniform(0.2, 1, bits))
    for text in ["the quick brown fox", "a", "ßé 12", "zz " * 3000]:
        f = language.features(text) @ model.weights + model.bias
        loss = [sum(t * np.log1p(np.exp(-c * v)) for t, c, v in zip(model.trust, word, f, strict=True)) for word in code]
        best = min(range(k), key=lambda i: (loss[i], i))
        lang, score, unsure = model.decide(text)
        assert lang == f"l{best}" and score == pytest.approx(1 / sum(np.exp(loss[best] - v) for v in loss))
        assert unsure == (k > 1 and sorted(loss)[1] - loss[best] < language.MARGIN)


def test_language_stage_rejects_what_is_ambiguous(spark):
    """A text that no language claims more than another goes; what one claims stays."""
    r = np.random.default_rng(1)
    word = lambda letters: "".join(r.choice(list(letters), r.integers(3, 8)))
    rows = [(k, " ".join(word("abcd" if k % 2 else "wxyz") for _ in range(40)), "l1" if k % 2 else "l2") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    model.bias[:] = 0
    unknown = next(w for w in (word("mnopqrst") for _ in range(9999)) if not model.weights[language.features(w) > 0].any())
    odd = spark.createDataFrame([(1, "abcd dcba", None), (2, "", None), (3, unknown, None)], "doc_id long, text string, lang string")
    assert [x.doc_id for x in language.accepted(odd, model).collect()] == [1]
    assert language.accepted(docs, model).count() == 60


def plain_threads(rows):
    """(conv_id, turn, body, reply_to, root, depth) of each row, by loops over all messages."""
    marks = re.compile(r"^(?:[ \t]{0,3}>)+")
    even = lambda s: re.sub(r"[ \t\n\x0b\f\r]+", " ", s).strip(" ").lower()

    def body(t):
        return "\n".join(x for x in t.split("\n") if not marks.match(x)).strip(" \t\n\x0b\f\r")

    known = [(c, t, x or "") for c, t, _, x in rows if c is not None and t is not None]
    replies = {}
    for c, t, x in known:
        parts, last = [], 0
        for line in x.split("\n"):
            m = marks.match(line)
            level = m[0].count(">") if m else 0
            if level and level != last:
                parts.append((level, []))
            if level:
                parts[-1][1].append(line[len(m[0]) :])
            last = level
        low = min([p[0] for p in parts], default=0)
        for level, lines in parts:
            if level != low:
                continue
            others = [(t2, body(x2)) for c2, t2, x2 in known if c2 == c and body(x2)]
            whole = min([t2 for t2, b in others if even(b) == even("\n".join(lines))], default=None)
            origin = whole if whole is not None and whole < t else None
            wanted = {even(s) for s in lines if even(s)}
            if origin is None and wanted:
                by_turn = {}
                for t2, b in others:
                    by_turn.setdefault(t2, set()).update(even(s) for s in b.split("\n") if even(s))
                votes = [(-len(wanted & has), t2) for t2, has in by_turn.items() if t2 < t and wanted & has]
                origin = min(votes)[1] if votes else None
            if origin is not None:
                replies[c, t] = max(origin, replies.get((c, t), origin))
    out = []
    for c, t, _, x in rows:
        up, depth = t, 0
        while (c, up) in replies:
            up, depth = replies[c, up], depth + 1
        out.append((c, t, body(x or ""), replies.get((c, t)), up, depth))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_chat_against_plain_threads(spark, seed):
    r, rows = random.Random(seed), []
    for conv in range(6):
        bodies = {}
        for turn in range(r.choice([1, 3, 12])):
            lines = []
            for _ in range(r.randint(0, 2) if turn else 0):
                quoted = bodies[r.choice(list(bodies))].split("\n")
                part = quoted if r.random() < 0.5 else r.sample(quoted, r.randint(1, len(quoted)))
                level = r.choice([1, 1, 2, 3])
                lines += [f"{r.choice(['> ', '>', ' > ']) * level}{s.upper() if r.random() < 0.2 else s}" for s in part] + [r.choice(["", "says:", "> "])]
            own = [r.choice(["hi all", "best, A", "", "  budget is  5", f"only {conv} {turn}", "é ß"]) for _ in range(r.randint(0, 4))]
            bodies[turn] = "\n".join(own) or "ok"
            rows.append((conv, turn, r.choice(["user", None]), r.choice([None, ""]) if r.random() < 0.05 else "\n".join([*lines, bodies[turn]])))
    rows += [(None, 1, "user", "> hi all"), (1, None, "user", "> hi all\nx"), rows[-1], rows[0], (0, 90, "user", "> hi all\n" + "a long line of it\n" * 20_000)]
    df = spark.createDataFrame([(*x, "x", "y") for x in rows], "conv_id long, turn long, role string, text string, root string, passage string")
    got = [(x.conv_id, x.turn, x.body, x.reply_to, x.root, x.depth) for x in chat.formatted(df).collect()]
    assert sorted(got, key=str) == sorted(plain_threads(rows), key=str)
    conversations = pa.table({c: [x[k] for x in rows] for k, c in enumerate(("conv_id", "turn", "role", "text"))})  # noqa: F841
    again = duckdb.connect().sql(chat.SQL).fetchall()
    assert sorted([(x[0], x[1], x[3], x[5], x[6], x[7]) for x in again], key=str) == sorted(got, key=str)
    assert chat.formatted(df.where("false")).count() == 0


def test_images_of_awkward_rows(spark):
    rows = [(1, None, "x"), (2, [], "x"), (3, [0.0] * 64, "x"), (4, [float("nan")] * 64, "x"), (20, [1.0] * 64, "x"), (20, [1.0] * 64, "x"), (None, [1.0] * 64, "x"), (5, [1.0, None], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    out = media.search(df, lambda i: i % 20 == 0).toPandas()
    assert len(out[out.row_kind == "member"]) == len(rows)
    assert {(r.vec_id, r.rep_id) for r in out[out.row_kind == "match"].itertuples()} <= {(20, 20)}
    odd = spark.createDataFrame([(1, 0, 0, bytearray(b"")), (2, 5, 5, bytearray(25)), (3, None, None, None), (4, 9, 9, bytearray(3)), (5, 500, 500, bytearray(250_000))], "id long, width int, height int, pixels binary")
    assert media.matches(odd, odd, 100).count() == 0


def test_pages_of_great_length():
    page = "<article>" + "<p>Some words of the article.</p>" * 30_000 + "</article><footer>no</footer>"
    assert html.main_text(page) == " ".join(["Some words of the article."] * 30_000)


def test_pipeline_over_awkward_tables(spark, tmp_path):
    import corpus_pipeline

    for k, texts in enumerate([TEXTS, []]):
        df = table(spark, texts) if texts else table(spark).where("false")
        (tmp_path / str(k)).mkdir()
        df.write.parquet(f"{tmp_path}/{k}/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/0").toPandas()
    assert sorted(set(out.doc_id.fillna(-1))) == [3, 5, 8]
    docs = spark.read.parquet(f"{tmp_path}/1/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"{tmp_path}/1")
        assert out.count() == 0 and (out.columns == docs.columns or stage is corpus_pipeline.pack)
