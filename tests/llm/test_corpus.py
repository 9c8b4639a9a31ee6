"""Deduplication, scoring, media, chat and the pipeline: against brute force."""

import collections
import re

import numpy as np
import pytest

from cloudloom.llm import chat, components, exact_dedup, lm, media, neardup


def test_exact_dedup_keeps_texts_of_one_digest_apart(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(5, "a b"), (3, "ab"), (9, "a  b"), (1, None), (2, " \n"), (7, "zz"), (7, "zz"), (None, "q"), (8, "ca")]
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(path)
    for digest in (exact_dedup.sha256, lambda t: F.substring(exact_dedup.sha256(t), 1, 0)):
        for files in (None, 1):
            got = exact_dedup.assignments(spark, path, digest, files).collect()
            assert len(got) == len(rows)
            kept = sorted((r.keep_id if r.keep_id is not None else -1, r.group_size) for r in got if r.kept)
            assert kept == [(-1, 1), (2, 2), (7, 2), (8, 1), (9, 3)]


def test_exact_dedup_reads_folders_and_files_of_any_name(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a "), (3, "b")], "doc_id long, text string").coalesce(1)
    for name in ("plain", "odd [1] {a,b} x*?"):
        folder = f"{tmp_path}/{name}"
        df.write.parquet(folder)
        (file,) = [p for p in (tmp_path / name).iterdir() if p.name.startswith("part-")]
        for path in (folder, str(file)):
            got = exact_dedup.assignments(spark, path).collect()
            assert sorted((r.doc_id, r.keep_id, r.kept) for r in got) == [(1, 2, False), (2, 2, True), (3, 3, True)]


def test_exact_dedup_of_nothing_and_of_extra_columns(spark):
    df = spark.createDataFrame([(1, "a", 3, "k"), (2, "a ", 4, "k")], "doc_id long, text string, n long, digest string")
    assert exact_dedup.dedup(df.where("false")).count() == 0
    out = exact_dedup.dedup(df)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [2]


def brute_classes(ids, texts):
    bags = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter() for w in map(neardup.words_of, texts)]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both, either = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            if either and both / either >= 0.8:
                x, y = sorted((find(ids[a]), find(ids[b])))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, monkeypatch):
    r = np.random.default_rng(4)
    word = lambda n: [f"w{k}" for k in r.integers(0, 5000, n)]
    texts = [" ".join(word(80)) for _ in range(20)]
    base, passage = word(120), word(60)
    for _ in range(40):  # a large group of near copies, some of them far from each other
        w = list(base)
        for k in r.integers(0, 120, r.integers(0, 6)):
            w[k] = f"x{r.integers(0, 10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(passage + word(40)) for _ in range(15)] + ["a b a b a b a b a b a b", "a b a b a b a b a b a b a b", "one", "ONE", "", None, None]
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in neardup.classes(df).collect()}
    assert got == brute_classes(ids, texts)
    monkeypatch.setattr(neardup, "MINOR_NODES", 3)
    monkeypatch.setattr(neardup, "OTHER_NODES", 5)
    assert {x.doc_id: x.class_id for x in neardup.classes(df).collect()} == got
    odd = spark.createDataFrame([(None, "a b c", 1), (4, "a b c", 2), (4, "a b c", 3)], "doc_id long, text string, key int")
    assert neardup.dedup(odd).count() == 3 and neardup.dedup(odd).columns == odd.columns
    assert neardup.classes(df.where("false")).count() == 0


def test_bagminhash_is_unbiased():
    r, errors = np.random.default_rng(0), []
    for q in range(20):
        x = neardup.mix(np.arange(1, 301, dtype=np.uint64) + np.uint64(q * 1000))
        a = r.integers(1, 6, 300)
        b = np.where(np.arange(300) < 60, r.integers(1, 9, 300), a)
        same = (neardup.bagminhash(x, a, 400) == neardup.bagminhash(x, b, 400)).mean()
        errors.append(same - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.012


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 30)] + [(100, 101), (101, 105), (105, 105)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(2, 31)} | {101: 100, 105: 100}


def test_cross_entropy_difference(spark):
    rows = [(k, "alpha beta gamma delta " * 5) for k in range(5)] + [(k, "one two three four " * 5) for k in range(5, 10)] + [(10, None), (11, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (1, 0), (6, 0), (None, 1)], "doc_id long, quality int")
    models = lm.train(lm.marked(docs, labels))
    assert models.total.tolist() == [200, 40]
    got = {r.doc_id: r for r in lm.scored(docs, models).collect()}
    assert got[2].score < 0 < got[7].score and got[10].score == got[11].score == 0 and got[2].n_tokens == 20
    assert lm.scored(docs.where("false"), lm.train(lm.marked(docs.where("false"), labels))).count() == 0


def brute_scores(texts, good, new=None):
    """n_tokens and both losses by plain dictionaries; of the counted texts each without itself, or of new texts."""
    words = [(t or "").lower().split() for t in texts]
    n = [[collections.Counter(), collections.Counter(), 0] for _ in range(2)]

    def counted(w):
        return collections.Counter([None] * bool(w) + w), collections.Counter(zip([None, *w], w, strict=False))

    for k, w in enumerate(words):
        for model in n[: 1 + (k in good)]:
            for c, more in zip(model, counted(w), strict=False):
                c.update(more)
            model[2] += len(w)
    share = n[1][2] / max(1, n[0][2])

    def hashed(a, b=None):
        x, y = (lm.START if v is None else np.uint64(lm.word_hashes([v])[0]) for v in (a, b))
        return lm.mix(np.array([x]) * np.uint64(0xD6E8FEB86659FD93) + y) if b is not None else np.array([x])

    def thin(count, key):
        return np.floor(count * share + lm.spread(key)[0])

    out = []
    for k, w in enumerate(words if new is None else [(t or "").lower().split() for t in new]):
        own = counted(w) if new is None else counted([])
        off = len(w) * (new is None)
        losses = []
        for m in (1, 0):
            total, all_tokens = 0.0, n[0][2] - off
            for a, b in zip([None, *w], w, strict=False):
                every = [n[0][0][b] - own[0][b], n[0][1][a, b] - own[1][a, b], n[0][0][a] - own[0][a]]
                if not every[0]:
                    total -= np.log(lm.MIX[2] / (all_tokens + 1))
                    continue
                prior = every[0] / max(1, all_tokens)
                if m:
                    mine = [n[1][0][b] - own[0][b] * (k in good), n[1][1][a, b] - own[1][a, b] * (k in good), n[1][0][a] - own[0][a] * (k in good)] if new is None else [n[1][0][b], n[1][1][a, b], n[1][0][a]]
                    tokens = n[1][2] - off * (k in good)
                else:
                    mine, tokens = [thin(c, h) for c, h in zip(every, (hashed(b), hashed(a, b), hashed(a)), strict=True)], all_tokens * share
                of_pair = lm.MIX[0] if mine[2] > 0 else 0
                p = of_pair * min(1, mine[1] / max(1, mine[2])) + (lm.MIX[0] + lm.MIX[1] - of_pair) * mine[0] / max(1, tokens) + lm.MIX[2] * prior
                total -= np.log(p if tokens >= 1 else prior)
            losses.append(total / max(1, len(w)))
        out.append((len(w), *losses))
    return out


@pytest.mark.parametrize("vocabulary, long", [(400_000, 5000), (60, 300)])
def test_cross_entropy_difference_against_plain_dictionaries(spark, monkeypatch, tmp_path, vocabulary, long):
    """As many different words as would fill any fixed cells, and few; over several blocks and buckets; copies, one-word, empty, null and unlabelled texts, repeated and null ids, clashing columns."""
    monkeypatch.setattr(lm, "BLOCK", 400_000 if long > 300 else 3000)
    r = np.random.default_rng(4)
    texts = [" ".join(f"w{v}" for v in r.integers(0, vocabulary, long)) for _ in range(60)] + [None, "", "w1 w1 W2", "w1", "x" * 5000, " ".join(["w3"] * 20_000)]
    texts += texts[:3]
    good = set(range(0, 60, 3)) | {62}
    ids = [*range(len(texts) - 1), None]
    rows = [(i, t, 1, "b", k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    spark.createDataFrame(rows, "doc_id long, text string, block int, bucket string, label long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k in good)) for k in range(0, 64)] + [(None, 1), (0, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    got = {row.doc_id: row for row in lm.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, want in zip(ids, brute_scores(texts, good), strict=True):
        assert (got[i].n_tokens, got[i].target_loss, got[i].background_loss) == pytest.approx(want, rel=1e-9, abs=1e-9), i
        assert got[i].score == pytest.approx(want[1] - want[2], abs=1e-9)
    new = ["w1 w2 w3 never-seen", None, texts[0]]
    some = spark.createDataFrame(list(enumerate(new)), "doc_id long, text string")
    again = {row.doc_id: row for row in lm.scored(some, lm.train(lm.marked(docs, labels))).collect()}
    for i, want in enumerate(brute_scores(texts, good, new)):
        assert (again[i].n_tokens, again[i].target_loss, again[i].background_loss) == pytest.approx(want, rel=1e-9, abs=1e-9), i


def test_cross_entropy_difference_without_a_target(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows, blocks = lm.marked(docs, labels)
    out = lm.losses(rows, lm.sums(lm.counts(rows, lm.buckets_of(blocks)))).collect()
    assert sorted(r.doc_id for r in out) == [1, 2] and all(np.isfinite([r.target_loss, r.background_loss, r.score]).all() and r.score == 0 for r in out)


def test_media_finds_cropped_and_edited_copies(spark):
    r = np.random.default_rng(2)
    rows = [(k, [float(v) for v in r.normal(size=64)]) for k in range(45)]
    rows += [(100, rows[3][1]), (101, None), (102, []), (103, [0.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = media.search(df, lambda i: i % 20 == 0).toPandas()
    member = out[out.row_kind == "member"].set_index("vec_id").rep_id.to_dict()
    assert len(member) == len(rows) and member[100] == 3
    found = set(map(tuple, out[out.row_kind == "match"][["vec_id", "rep_id"]].astype(int).to_numpy()))
    assert {(0, 0), (20, 20), (40, 40), (3, 3)} == found
    assert media.search(df.where("false"), lambda i: i % 20 == 0).count() == 0


def grey(n, seed):
    return np.stack([np.frombuffer(p, np.uint8).reshape(media.SIDE, -1) for p in media.rendered([list(v) for v in np.random.default_rng(seed).normal(size=(n, 64))])])


def turned(a, degrees, size):
    """Images turned about their centre and scaled, between pixels."""
    c, t = (a.shape[1] - 1) / 2, np.deg2rad(degrees)
    y, x = np.mgrid[0 : a.shape[1], 0 : a.shape[2]] - c
    u, v = (x * np.cos(t) + y * np.sin(t)) / size + c, (y * np.cos(t) - x * np.sin(t)) / size + c
    i, j = (np.clip(np.floor(w).astype(int), 0, a.shape[1] - 2) for w in (v, u))
    f, g = np.clip(v - i, 0, 1), np.clip(u - j, 0, 1)
    return (a[:, i, j] * (1 - f) * (1 - g) + a[:, i, j + 1] * (1 - f) * g + a[:, i + 1, j] * f * (1 - g) + a[:, i + 1, j + 1] * f * g).astype(np.uint8)


@pytest.mark.parametrize("kind", ["crop", "turn 90", "turn 20", "scale", "noise"])
def test_media_meets_what_brute_force_matches(kind):
    base = grey(100, 6)
    noise = np.random.default_rng(1).normal(0, 12, base.shape)
    copies = {
        "crop": lambda: base[:, 9:81, 14:86], "turn 90": lambda: np.rot90(base, 1, (1, 2)).copy(), "turn 20": lambda: turned(base, 20, 1),
        "scale": lambda: turned(base, 0, 1.15), "noise": lambda: np.clip(base + noise, 0, 255).astype(np.uint8),
    }[kind]()
    q, d = (np.concatenate([np.ascontiguousarray(part[5]).view(np.uint64) for part in media.describe(x)]) for x in (copies, base))
    apart = np.stack([np.bitwise_count(d ^ one).sum(1) for one in q])
    want = set(zip(*np.nonzero(apart <= media.NEAR), strict=True))
    far = set(zip(*np.nonzero((apart > 40) & (apart <= media.NEAR)), strict=True))
    got = set(zip(*media.near_pairs(q, d), strict=True))
    assert got <= want and len(got) >= 0.97 * len(want) and len(got & far) >= 0.95 * len(far) > 0


def test_media_keeps_the_corners_of_every_part(spark):
    """The weaker half of an image has its own corners beside a strongly textured one, and a crop of it is found."""
    weak, strong = grey(2, 8)
    whole = np.hstack([128 + (weak.astype(int) - 128) // 3, np.tile(strong, (1, 3))]).astype(np.uint8)
    crop = whole[4:92, 2:94].copy()

    found = media.matches(pictures(spark, {1: crop}), pictures(spark, {2: whole}), 200).collect()
    assert [(r.query, r.found) for r in found] == [(1, 2)] and found[0].inliers >= 10


def pictures(spark, arrays):
    rows = [(k, a.shape[1], a.shape[0], bytearray(a.tobytes())) for k, a in arrays.items()]
    return spark.createDataFrame(rows, "id long, width int, height int, pixels binary")


@pytest.mark.parametrize("size", [27])
def test_media_finds_the_images_that_brute_force_finds(spark, monkeypatch, size):
    """Of all pairs of images with enough agreeing matches among all pairs of their corners, by the words, in two tables, of an index of 130 million corners; blocks and parts of cells are small, so there are many."""
    monkeypatch.setattr(media, "BLOCK", 60)
    monkeypatch.setattr(media, "SHARE", 100)
    monkeypatch.setattr(media, "TOGETHER", 8)
    monkeypatch.setattr(media, "word_size", lambda corners: size)
    base = grey(30, 6)
    noise = np.random.default_rng(1).normal(0, 12, base.shape)
    border = np.pad(base[:, 10:86, 10:86], [(0, 0), (20, 20), (20, 20)], constant_values=30)
    half = (base[:, ::2, ::2].astype(int) + base[:, 1::2, ::2] + base[:, ::2, 1::2] + base[:, 1::2, 1::2]) // 4
    copies = [base[:, 9:81, 14:86], np.rot90(base, 1, (1, 2)), turned(base, 20, 1), turned(base, 0, 1.15), np.clip(base + noise, 0, 255), border, half]
    queries = {100 * kind + k: np.ascontiguousarray(a).astype(np.uint8) for kind, one in enumerate(copies) for k, a in enumerate(one)}
    got = {(r.query, r.found): r.inliers for r in media.matches(pictures(spark, queries), pictures(spark, dict(enumerate(base))), 10**5).collect()}
    corners = lambda a: np.concatenate([np.concatenate(c) if c else np.zeros(0, media.CORNER) for c in [[packed(p) for p in media.describe(a[None])]]])
    held, want = [corners(a) for a in base], {}
    for k, a in queries.items():
        q = corners(a)
        for i, d in enumerate(held):
            x, y = np.nonzero(np.bitwise_count(np.ascontiguousarray(q["bits"]).view("<u8")[:, None] ^ np.ascontiguousarray(d["bits"]).view("<u8")).sum(2) <= media.NEAR)
            n = media.agreeing(q[x], np.zeros(len(x), int), d[y], np.zeros(len(x), int))[2]
            if len(n):
                want[k, i] = int(n[0])
    assert got.items() <= want.items() and {k % 100 for k, _ in want} == set(range(30))
    for kind in range(len(copies)):
        of = {p for p in want if p[0] // 100 == kind}
        share = len(of & set(got)) / len(of)
        print(f"size {size} kind {kind}: {share:.3f} of {len(of)}")
        assert share >= 0.9, (kind, share)


def packed(part):
    image, x, y, turn, scale, bits, _ = part
    out = np.zeros(len(x), media.CORNER)
    out["x"], out["y"], out["turn"], out["scale"], out["bits"] = x, y, turn, scale, bits
    return out


def test_chat(spark):
    rows = [(1, 0, "user", "Hello there\nhow are you?"), (1, 1, "assistant", "> Hello there\n> how are you?\nFine."), (1, 2, "user", "> > how are you?\n> Fine.\nGood"), (1, 3, None, None),
            (None, 1, "user", "> x"), (1, 4, "user", "On x:\n> how  ARE you?\nwell"), (2, 0, "user", "> Fine.\nno")]
    out = [(r.conv_id, r.turn, r.body, r.reply_to, r.root, r.depth) for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert out == [(None, 1, "", None, 1, 0), (1, 0, "Hello there\nhow are you?", None, 0, 0), (1, 1, "Fine.", 0, 0, 1), (1, 4, "On x:\nwell", 0, 0, 1), (1, 2, "Good", 1, 0, 2), (1, 3, "", None, 3, 0), (2, 0, "no", None, 0, 0)]
    long = [(7, k, "user", (f"> line {k - 1}\n" if k else "") + f"line {k}") for k in range(20)]
    deep = chat.formatted(spark.createDataFrame(long, "conv_id long, turn long, role string, text string")).toPandas()
    assert deep.depth.tolist() == list(range(20)) and (deep.root == 0).all()


def test_chat_counts_all_messages_with_a_line(spark):
    rows = [(1, 1, "Hi all\nBest, A"), (1, 2, "Hi all\nno"), (1, 5, "Hi all\nBudget is 5\nand more\nBest, A"), (1, 6, "> Hi all\n> Budget is 5\nok"), (1, 7, "> Hi all\n> Hi all\n> Best, A\n> Budget is 5\nok"), (1, 8, "> Hi all\nhi")]
    got = {r.turn: (r.reply_to, r.root, r.depth) for r in chat.formatted(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: (None, 1, 0), 2: (None, 2, 0), 5: (None, 5, 0), 6: (5, 5, 1), 7: (5, 5, 1), 8: (1, 1, 1)}


def test_pipeline_against_stages_by_hand(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    docs = docs[[bool(t) and any(map(str.isalpha, t)) for t in docs.text]]
    norm = docs.text.str.replace(r"[\x20\x09-\x0D]", "", regex=True)
    docs = docs.assign(norm=norm, n=docs.text.str.len()).sort_values(["n", "doc_id"], ascending=[False, True]).drop_duplicates("norm").sort_values("doc_id")
    classes = brute_classes(docs.doc_id.tolist(), docs.text.tolist())
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(got.doc_id) == set(classes.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "personal_data", "packing"]


def test_no_task_of_near_duplicates_takes_two_python_workers(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    keys = spark.createDataFrame([(neardup.key_of(["a", "b", "c"]),)], "key binary")
    bags = neardup._bags(docs, spark.range(1, 2).toDF("doc_id"), keys)
    assert [bytes(r.key) for r in bags.collect()] == [neardup.key_of(["a", "b", "c"])]
    stages = re.split(r"Exchange", bags._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
    assert sum("MapInArrow" in s for s in stages) == 2 and max(s.count("MapInArrow") for s in stages) == 1
