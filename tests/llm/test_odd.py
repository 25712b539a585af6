"""Null and repeated ids, repeated rows, empty tables, clashing columns and large values, for operators whose other tests use clean rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_llm import DOCS, LONG, ODD, brute_components, frame

from pagemill.llm import common, langid, near_dedup, packing, secrets, shards, suffixes, tokencount, topk, toxicity

IDS = [None, None, 3, 3, 3, 1, 2, 2, None, 5, 6]


def test_near_dedup_by_rows(spark):
    """Links go by texts, whatever ids say; rows of null and repeated ids all stay rows."""
    words = [f"w{i}" for i in range(60)]
    a, b, c = (" ".join(random.Random(s).sample(words, 60)) for s in (1, 2, 3))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (3, b + " y"), (None, a), (None, c), (None, c + " z"), (None, None), (4, ""), (4, ""), (7, LONG), (6, LONG)]
    got = near_dedup.near_components(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    want = []
    for (n, c), (i, _) in zip(brute := brute_components([t for _, t in rows]), rows):
        ids = [j for (_, d), (j, _) in zip(brute, rows) if d == c and j is not None]
        name = min(ids) if n and ids else None if n else i
        want.append((i, n, name, i == name if i is not None and name is not None else name is None))
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter(want)


def test_one_row_of_each_group_stays(spark):
    texts = ["a b c d e f g"] * 5 + ["other words than those in the first"] * 2 + [None, None, ""]
    docs = common.row_ids(frame(spark, texts, [2, 1, 1, None, 3, None, None, 1, 1, 9]))
    gone = {(r._file, r._row) for r in near_dedup.repeated_rows(docs).collect()}
    kept = [(r.doc_id, r.text) for r in docs.collect() if (r._file, r._row) not in gone]
    assert Counter(kept) == Counter([(1, texts[0]), (None, texts[5]), (1, None), (1, None), (9, "")])


def test_row_ids_are_the_same_at_each_reading(spark, tmp_path):
    frame(spark, ["x"] * 1000 + [None] * 1000, [None] * 2000).repartition(7).write.parquet(str(tmp_path / "t"))
    read = lambda: {(r._file, r._row) for r in common.row_ids(spark.read.parquet(str(tmp_path / "t"))).select("_file", "_row").collect()}
    assert len(read()) == 2000 and read() == read()


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(8)
    for low, high in ((10**8, 10**9), (10**15, 10**18)):
        rows = [(i, [int(x) for x in rng.integers(low, high, 5) * rng.choice([-1, 1], 5)]) for i in range(300)]
        v = spark.createDataFrame(rows, "vec_id long, v array<long>")
        got = defaultdict(list)
        for r in topk.top_k(v, v.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        for q in (0, 100, 200):
            scores = [(i, sum(a * b for a, b in zip(rows[q][1], x))) for i, x in rows if i != q]
            if high < 10**12:
                assert got[q] == sorted(scores, key=lambda s: (-s[1], s[0]))[:10]
            else:
                fit = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
                assert [s for _, s in got[q]] == [fit(s) for _, s in sorted(scores, key=lambda s: -s[1])[:10]]


def test_top_k_reads_in_blocks(spark):
    rng = np.random.default_rng(9)
    v = spark.createDataFrame([(i, [int(x) for x in rng.integers(-50, 50, 16)]) for i in range(2000)], "vec_id long, v array<long>")
    q = v.filter("vec_id % 100 = 0")
    one, many = (sorted(map(tuple, topk.top_k(v, q, block=b).collect())) for b in (4096, 7))
    assert one == many and len(one) == 200


def test_shards_of_null_and_repeated_ids(spark):
    docs = frame(spark, [f"text {i % 5}" for i in range(3000)], [None] * 1500 + [7] * 1500)
    out = shards.shuffle_shards(docs, bucket_bytes=4000).toPandas()
    sizes = out.groupby("shard").size()
    assert len(out) == 3000 and sizes.max() - sizes.min() <= 1 and all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard").slot)
    # the order is a shuffle: the first half's rows are spread over all shards and slots
    first = out[out.doc_id.isna()]
    assert first.groupby("shard").size().min() > 30 and abs(first.slot.mean() - out.slot.mean()) < 6


def test_shards_by_brute_force(spark, tmp_path):
    """The places of a plain two-pass shuffle of the same buckets."""
    frame(spark, [f"t{i}" for i in range(400)]).coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    size = sum(len(f"t{i}") + len("en") + len("clash") + 16 * 7 for i in range(400))
    n = -(-size // 3000)
    rows = common.row_ids(docs).selectExpr("doc_id", "_row", f"pmod(xxhash64(17, _file, _row), {n}) AS bucket").orderBy("bucket", "_row").collect()
    buckets = defaultdict(list)
    for r in rows:
        buckets[r.bucket].append(r.doc_id)
    order = []
    for b in sorted(buckets):
        own, draws = buckets[b], np.random.Generator(np.random.PCG64([17, b])).random(len(buckets[b]))
        for i in range(len(own) - 1, 0, -1):
            j = int(draws[i] * (i + 1))
            own[i], own[j] = own[j], own[i]
        order += own
    got = {r.doc_id: (r.shard, r.slot) for r in shards.shuffle_shards(docs, bucket_bytes=3000).collect()}
    assert got == {d: (p % 24, p // 24) for p, d in enumerate(order)}


def test_packing_odd_rows(spark):
    texts = ["same", "same", None, None, "", LONG, LONG]
    p = packing.pack_documents(frame(spark, texts, [None, None, None, 1, 1, 2, 2])).toPandas()
    single = packing.pieces(frame(spark, texts)).count()
    assert len(p) == single
    for _, g in p.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 1024


def test_empty_tables(spark):
    none = frame(spark, [])
    assert secrets.scan_secrets(none).count() == secrets.drop_secrets(none).count() == 0
    assert langid.learn(none) is None and langid.identify(none, None).count() == 0
    model = toxicity.learn(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(none, model).count() == 0


def test_repeated_rows(spark):
    twice = frame(spark, [*ODD, *ODD], IDS * 2)
    assert secrets.scan_secrets(twice).count() == langid.identify(twice, None).count() == suffixes.repeated_spans(twice).count() == len(ODD) * 2
    assert toxicity.score_toxicity(twice, toxicity.Model({" hello ": 5.0}, frozenset(), -3.0, (1.0, 0.0, 0.0))).filter("score > 0.5").count() == 2
    assert set(langid.identify(twice, None).columns) == {*twice.columns, "lang_pred"}  # its score replaces the clashing one


def test_secret_offsets_in_wide_texts():
    s = secrets.Scanner().prepare()
    text = "é漢😀 token = abcdef12 " * 200 + "é AKIA" + "Z9" * 9
    assert [x for x in s.spans(text) if x[0] in ("assign", "access", "hex")] == secrets.brute(text)


def test_language_by_enumeration():
    """Probabilities of a small model's documents by summing over all label sequences."""
    from itertools import product

    rng = np.random.default_rng(2)
    weights = rng.normal(0, 0.3, (langid.NONE + 1, 3)).astype(np.float32)
    weights[langid.NONE] = 0
    model = langid.Model(["a", "b", "c"], weights, rng.normal(size=(3, 3)))
    texts = ["one", "two small words", "ein paar Wörter mehr", "x y z x y", None, "123 !?"]
    langs, scores, probs = langid.predict(texts, model)
    for t, lang, score, p in zip(texts, langs, scores, probs):
        w = langid.normal(t)
        if not w:
            assert (lang, score) == ("und", 0.0)
            continue
        e, n = langid.emissions(w, weights).astype(float), w.count(b" ") + 1
        mean, total = np.zeros(3), 0.0
        for ys in product(range(3), repeat=n):
            z = np.exp(sum(e[i, y] for i, y in enumerate(ys)) + sum(model.moves[a, b] for a, b in zip(ys, ys[1:])))
            total += z
            mean += z * np.bincount(ys, minlength=3) / n
        assert np.allclose(p, mean / total, atol=1e-5) and lang == "abc"[int(np.argmax(mean))] and abs(score - max(mean / total)) < 1e-5


def test_toxicity_by_plain_search():
    """A model's scores, with every term looked for in every place."""
    terms = {" vile ": 4.0, " awfu": 3.0, " dull ": 2.5}
    model = toxicity.Model(terms, frozenset({"dull knife"}), -2.0, (0.5, 0.4, 0.3))
    for t in ["A v1le and awful text", "a dull knife", "dull dull knife", "AWFULLY vile, vile!", "", None, "nothing here", "vi|e awfu"]:
        f, best = toxicity.fold(t), {}
        for term, w in terms.items():
            for i in range(len(f)):
                if f.startswith(term, i):
                    words, at = f.split(), len(f[: i + 1].split())
                    pair = {" ".join(words[max(0, at - 1) : at + 1]), " ".join(words[at : at + 2])}
                    if "dull knife" not in pair:
                        best[i] = max(w, best.get(i, 0))
        total = sum(best.values())
        x = (max(best.values()), np.log1p(total), total / np.sqrt(1 + f.count(" "))) if best else (0, 0, 0)
        assert abs(toxicity.Matcher(model).score(t) - 1 / (1 + np.exp(2.0 - np.dot(model.slopes, x)))) < 1e-9, t


def test_edits_in_any_script_touch_little():
    counter, rng = tokencount.Counter(), np.random.default_rng(3)
    for word in ("plain words ", "d\u2019accord \u2013 oui ", "\u6f22\u5b57 \u4eee\u540d\u3002"):
        tree = tokencount.Tree(word * 20000, counter)
        for _ in range(3):
            before = tree.encoded
            tree.edit(int(rng.integers(0, len(tree.text))), 3, word)
            assert tree.encoded - before < 1000
        assert tree.total == len(counter.coder.fast.encode_ordinary(tree.text))
    tree, text = tokencount.Tree("", counter, 4), ""
    for i in range(300):  # a text that grows at one place keeps small leaves
        tree.edit(0, 0, f"w{i} \u2019")
        text = f"w{i} \u2019" + text
    assert tree.total == len(counter.coder.fast.encode_ordinary(text)) and tree.leaves > 40


def test_a_cluster_must_share_a_folder():
    class Context:
        applicationId, master = "other", "spark://host:7077"

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        common.shared_folder(Session())


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    bench = "this passage of the benchmark has ten words and some more"
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    prose = "The weather in the north was cold and the people of the town stayed at home until the spring came again. "
    spoken = "Das Wetter im Norden war kalt und die Menschen der Stadt blieben zu Hause bis der Frühling wieder kam. "
    copied = "Ein alter Mann ging jeden Morgen durch den stillen Wald und sammelte dort Holz für den langen Winter."
    rows = [(10 + i, (prose if i % 2 else spoken) * (1 + i % 3) + str(i), "en" if i % 2 else "de") for i in range(12)]
    rows += [(1, prose + "one", "en"), (1, prose + "one", "en"), (None, copied, None), (None, copied, None)]
    rows += [(1, f"clean row, {bench[:30]} but another end of it", "en"), (1, prose + bench, "en"), (2, "my password: hunter2hunter2 in english words", "en"), (3, None, "en"), (4, "", "en"), (5, "12 34 !?", "en")]
    docs = spark.createDataFrame([(i, t, l, "s", None, "clash", 1, 0.5) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long, spans string, _found int, score double")
    out, sizes = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out = common.cut(stage(spark, out, str(tmp_path)), name)
        sizes[name] = out.count()
        if name == "pack":
            break
        assert out.columns == docs.columns
        texts = [r.text for r in out.collect()]
        if name == "language":
            assert None not in texts and "" not in texts and "12 34 !?" not in texts and len(texts) == len(rows) - 3
        if name == "near_duplicates":
            assert len([t for t in texts if t == copied]) == 1 and texts.count(prose + "one") <= 1
        if name == "decontaminate":
            assert not any(bench in t for t in texts) and any(t.startswith("clean row") for t in texts)
        if name == "secrets":
            assert not any("hunter2" in t for t in texts) and any("[secret]" in t for t in texts)
    # stages that must pass on what only the first one drops
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs.filter("text IS NULL OR text = ''"), str(tmp_path)).count() == 2
    assert sizes["pack"] == out.count() and DOCS


def test_private_keys_go_whole():
    """A key's span ends with its last line, or with its long lines where that is missing; text behind it stays."""
    s, line = secrets.Scanner().prepare(), "aB3/" * 16
    body = f"Kind: 4,ENC-X\n\n{line}\n{line}\nab=\n"
    begin, end = "-----BEGIN RSA PRIVATE KEY-----\n", "-----END RSA PRIVATE KEY-----"
    key = begin + body + end
    for text, want in [
        (f"é {key} b", [(2, 2 + len(key))]),
        (f"{key}\n{key}", [(0, len(key)), (len(key) + 1, 2 * len(key) + 1)]),
        (key.replace("\n", "\\n"), [(0, len(key.replace("\n", "\\n")))]),
        (f"{begin}{line}\n{line}\nshort words behind", [(0, len(begin) + 2 * len(line) + 1)]),
        (f"{begin}words -- {end}", [(0, len(begin) - 1)]),
        ("-----BEGIN PRIVATE KEY--- no", []),
    ]:
        assert [(a, e) for k, a, e in s.spans(text) if k == "private_key"] == want, text
