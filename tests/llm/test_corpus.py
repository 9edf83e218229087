"""Each corpus operator against brute force on a small fixture with hard rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from oddrank.llm import (
    chat, common, components, decontamination, exact_dedup, html_text, minhash_dedup, packing, quality, queries, substring_dedup,
    suffix_dedup, suffix_tree, superminhash, token_store, tokens,
)

#: documents with two columns whose names the operators use inside
DOCS = "doc_id long, text string, label string, chunk int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "stone", "river", "light", "Ärger", "mill,", "word."]) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared = prose(rng, 70)
    base = prose(rng, 300)
    near = base.split()
    near[100] = "changed"
    out = [(i, prose(rng, rng.randrange(1, 120))) for i in range(20)]
    out += [(20, base), (21, " ".join(near)), (22, base), (23, base), (24, "a  b\t c\n\nd "), (25, None), (26, ""), (27, " \n"), (28, "one two")]
    out += [(29, prose(rng, 20) + " " + shared + " " + prose(rng, 9)), (30, shared + "\n" + prose(rng, 40)), (31, "One TWO"), (32, "ab" * 900)]
    out += [(33, prose(rng, 5000)), (22, base), (None, base), (None, "only null")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_exact_groups(docs, rows, none):
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    for r in got:
        text = next(t or "" for i, t in rows if i == r.doc_id and hashlib.sha256((t or "").encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(by[text])
        assert r.keep_id == max((i for i in by[text] if i is not None), default=None)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len(by)
    assert exact_dedup.exact_groups(none).count() == 0


def test_drop_copies_keeps_columns(docs, rows):
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.text or "" for r in left.collect()) == sorted({t or "" for _, t in rows})


def test_native_plans_have_no_python(docs, spark):
    told = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    for df in (exact_dedup.exact_groups(docs), chat.conversation_digest(chat.format_examples(told))):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_chat_round_trip(spark):
    hard = "\\ <|im_end|>\n<|im_start|>assistant \\l\\b<\\|"
    turns = [(1, 0, "system", hard), (1, 1, "user", None), (1, 2, "assistant", hard), (1, 3, "assistant", ""), (1, 4, None, "tail"),
             (2, 0, "user\nx", "q"), (3, None, "assistant", "z"), (3, 1, "assistant", "y" * 5000), (None, 0, "user", "n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    ex = chat.format_examples(df)
    assert sorted((r.conv_id or 0, r.example, r.n_turns) for r in ex.collect()) == [
        (0, 0, 1), (1, 0, 3), (1, 1, 4), (1, 2, 5), (2, 0, 1), (3, 0, 1), (3, 1, 2)
    ]
    got = {r.conv_id: r for r in chat.conversation_digest(ex).collect()}
    by = {}
    for c, t, role, text in turns:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    for c, own in by.items():
        own.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in own)
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_examples(df.limit(0)).count() == 0


def test_tokens_are_the_librarys(rows, monkeypatch):
    from tokenizers import Tokenizer

    coder, library = tokens.encoder(tokens.default_tokenizer()), Tokenizer.from_file(tokens.default_tokenizer())
    end = "<|endoftext|>"
    odd = ["  a b", "a  b", " a", "a ", "x \n", "it's I'll 's", f"{end} a", f"a{end}b {end}{end}", f"a b{end}", "é b c", "a\tb c\r\n d",
           "ñ\U0001f600 x", "a\x1cb \x1c c", "\u3000a b", "don't 12 34.5 a.b", None, ""]
    rng = random.Random(1)
    odd += ["".join(rng.choices(["a", "B", " ", "  ", "\n", ".", "'s", "1", "é", end, "\t", "ß ", " x"], k=rng.randint(0, 12))) for _ in range(400)]
    texts = [*odd, *(t for _, t in rows)]
    for long in (tokens.LONG, 40):  # the second cuts texts into parts
        monkeypatch.setattr(tokens, "LONG", long)
        ids, sizes = coder.batch(pa.array(texts), end_id=0)
        for t, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert own.tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 0], t
    monkeypatch.setattr(tokens, "MEMORY_BYTES", 100)
    assert coder.ids(texts[-2]).tolist() == library.encode(texts[-2], add_special_tokens=False).ids
    assert not len(coder.batch(pa.array([], pa.string()), 0)[0])


def test_token_store(spark, docs, rows, none, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(docs, path, shard_bytes=4000)
    got = token_store.store_digest(token_store.read_store(spark, path)).orderBy("start").collect()
    coder = tokens.encoder(tokens.default_tokenizer())
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(r.doc_id is not None, r.doc_id or 0) for r in got]
    at = 0
    want = sorted((i is not None, i or 0, zlib.crc32(np.append(coder.ids(t), 0).astype("<u4").tobytes())) for i, t in rows)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in got) == want
    found = token_store.read_documents(spark, path, [28, 33])
    assert found[28].tolist() == [*coder.ids("one two").tolist(), 0]
    token_store.write_store(none, str(tmp_path / "empty"))
    assert token_store.read_store(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(ValueError, match="dictionary"):
        codec = token_store.Codec(b"", 2)
        codec.hash = b"12345678"
        token_store.Codec(b"", 2).index(codec.pack([]))


def test_dictionary_round_trip():
    rng = np.random.default_rng(0)
    samples = [token_store.serialise(rng.integers(0, 50, 4000), 2) for _ in range(200)]
    codec = token_store.Codec(token_store.train_dictionary(samples, 4096), 2)
    arrays = [np.arange(5), np.empty(0, int), rng.integers(0, 60000, 300)]
    shard = codec.pack([(codec.compress(token_store.serialise(a, 2)), len(a)) for a in arrays])
    assert [codec.document(shard, i).tolist() for i in range(3)] == [a.tolist() for a in arrays]


def test_packing(docs, rows, none):
    got = packing.pack(docs, block_docs=8).collect()
    coder = tokens.encoder(tokens.default_tokenizer())
    pieces = {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    wanted = {}
    for i, t in rows:
        ids = [*coder.ids(t).tolist(), 0]
        wanted.setdefault((i, len(ids)), []).extend(enumerate(ids))
    assert pieces.keys() == wanted.keys()
    for key, p in pieces.items():  # rows that repeat an identifier and a size are read together
        assert sorted((start + k, x) for start, ids in p for k, x in enumerate(ids)) == sorted(wanted[key])
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, len(r.ids) // 4))
    for s in seqs.values():
        at = 0
        for offset, size in sorted(s):
            assert offset == at
            at += size
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack(none).count() == 0


def test_bm25_shard_against_the_formula():
    rng = np.random.default_rng(2)
    arrays = [rng.zipf(1.5, rng.integers(3, 60)).clip(0, 99).astype(np.uint32) for _ in range(40)]
    frequency = np.bincount(np.concatenate([np.unique(a) for a in arrays]), minlength=100)
    idf, mean = packing.inverse_frequency(frequency, 40), np.mean([len(a) for a in arrays])
    shard = packing.Shard(arrays, idf, mean)
    for q in (0, 7):
        for i, a in enumerate(arrays):
            want = sum(
                idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(a) / mean))
                for t, tf in ((t, (a == t).sum()) for t in np.unique(arrays[q])) if tf
            )
            assert shard.scores(q)[i] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_superminhash_estimates_without_bias():
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 2**62, 4000).astype(np.uint64)
    a, b = np.unique(pool[:300]), np.unique(pool[100:400])
    est = []
    for s in range(40):
        x = superminhash.signatures(
            np.concatenate([a, b]) ^ np.uint64(s * 7919), np.repeat([0, 1], [len(a), len(b)]), 2, 120
        )
        est.append((x[0] == x[1]).mean())
    assert abs(np.mean(est) - 0.5) < 0.02
    assert (superminhash.signatures(np.empty(0, np.uint64), np.empty(0, int), 2, 8) == superminhash.NEVER).all()


def brute_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(rows)))
    for _ in rows:
        for x in range(len(rows)):
            for y in range(len(rows)):
                both = len(sets[x] & sets[y])
                if sets[x] and sets[y] and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    label[x] = label[y] = min(label[x], label[y])
    out = []
    for x, (i, _) in enumerate(rows):
        ids = [rows[y][0] for y in range(len(rows)) if label[y] == label[x] and rows[y][0] is not None]
        out.append((i, len(sets[x]), (min(ids) if ids else None) if sets[x] else i))
    return out


@pytest.mark.parametrize("nodes", [1024, 2])
def test_near_duplicates(docs, rows, none, monkeypatch, nodes):
    monkeypatch.setattr(minhash_dedup, "BLOCK_NODES", nodes)
    got = minhash_dedup.near_duplicates(docs, shingle=3, percent=85).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(key, brute_components(rows, 3, 85)))
    if nodes > 2:
        assert minhash_dedup.near_duplicates(none).count() == 0
        left = minhash_dedup.drop_near_copies(docs)
        assert left.columns == docs.columns and left.where("doc_id IN (21, 23)").count() == 0


def test_block_labels_against_brute_force():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 30))).astype(np.uint64) for _ in range(60)]
    labels = minhash_dedup.block_labels(sets, 60)
    want = np.arange(60)
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 60 * (len(sets[i]) + len(sets[j]) - both):
                    want[i] = want[j] = min(want[i], want[j])
    assert (labels == want).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7), (None, 5)]
    got = dict(components.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_difference_cover_is_one():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))


def test_removed_words(docs, rows, none):
    last = 2**63 - 1
    first = {}
    for i, t in sorted(rows, key=lambda r: last if r[0] is None else r[0]):
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), last if i is None else i)
    want = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < (last if i is None else i):
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((str(i), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring_dedup.removed_words(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    assert sum(r.n_removed for r in got) > 0 and substring_dedup.removed_words(none).count() == 0


def test_repeated_spans_against_brute_force():
    rng = random.Random(1)
    for trial in range(150):
        least = rng.choice([3, 4, 6])
        texts = list({bytes(rng.choices(b"ab" if trial % 2 else b"abcd", k=rng.randint(least, 40))) for _ in range(rng.randint(1, 6))})
        weights = [rng.choice([1, 1, 2]) for _ in texts]
        count = {}
        for t, w in zip(texts, weights, strict=True):
            for i in range(len(t) - least + 1):
                count[t[i : i + least]] = count.get(t[i : i + least], 0) + w
        repeats, spans = suffix_tree.repeated_spans(texts, weights, least)
        for t, s in zip(texts, spans, strict=True):
            want, got = np.zeros(len(t), bool), np.zeros(len(t), bool)
            for i in range(len(t) - least + 1):
                want[i : i + least] |= count[t[i : i + least]] > 1
            for a, b in s:
                got[a:b] = True
            assert (want == got).all()
        for n, where in repeats:  # all occurrences, not only neighbours
            s = texts[where[0][0]][where[0][1] : where[0][1] + n]
            every = {(k, i) for k, t in enumerate(texts) for i in range(len(t) - n + 1) if t[i : i + n] == s}
            assert set(where) == every and len(every) > 1


@pytest.mark.parametrize("hot", [8192, 2])
def test_removed_bytes(docs, rows, none, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_PLACES", hot)
    count = {}
    bodies = [(i, (t or "").encode()) for i, t in rows]
    for _, b in bodies:
        for k in range(len(b) - 199):
            count[b[k : k + 200]] = count.get(b[k : k + 200], 0) + 1
    want = []
    for i, b in bodies:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((str(i), len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.removed_bytes(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert suffix_dedup.removed_bytes(none).count() == 0


def brute_leaks(rows, items):
    """Pairs of (doc_id, item_id): 80 % of the words agree in some 20 words of the item, or in all of fewer."""
    low = lambda t: words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = set()
    for i, t in rows:
        w = low(t)
        for name, item in items:
            v = low(item)
            need = min(20, len(v))
            for s in range(-len(v), len(w)) if v else ():
                inside = [0 <= s + k < len(w) for k in range(len(v))]
                eq = [a and w[s + k] == v[k] for k, a in enumerate(inside)]
                if any(all(inside[k : k + need]) and 100 * sum(eq[k : k + need]) >= 80 * need for k in range(len(v) - need + 1)):
                    found.add((i, name))
    return found


def test_decontamination(spark, docs, rows):
    item = " ".join(rows[33][1].split()[40:80]).split()
    item[5], item[20] = "other", "words"
    items = [(1, " ".join(item).upper()), (2, "not in any text at all " * 5), (3, None), (4, "one two"), (5, ""), (4, "one two"), (None, "a b")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("label", F.lit(0))
    got = decontamination.contamination(docs, bench).collect()
    assert len(got) == len(rows)
    brute = brute_leaks(rows, items)
    assert {(r.doc_id, x) for r in got for x in r.item_ids} == {p for p in brute if p[1] is not None} == {(33, 1), (28, 4), (31, 4)}
    assert {r.doc_id for r in got if r.contaminated} == {24, 28, 31, 33}
    left = decontamination.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == len(rows) - 4
    assert decontamination.matches(docs, bench.limit(0)).count() == 0
    assert decontamination.contamination(docs.limit(0), bench).count() == 0


def test_decontamination_misses_no_item_of_any_length(spark):
    rng = random.Random(3)
    rows, items = [], []
    for n in range(1, 31):
        for trial in range(3):
            v = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            items.append((100 * n + trial, " ".join(v)))
            for at in rng.sample(range(n), n * (20, 20, 30)[trial] // 100) if n < 20 or trial < 2 else range(0, n, 4):
                v[at] = "swapped"
            rows.append((len(rows), " ".join([*(["left"] * rng.randrange(4)), *v, *(["right"] * rng.randrange(4))])))
    rows += [(len(rows), " ".join(["left"] * 40)), (None, items[50][1])]
    want = brute_leaks(rows, items)
    assert len(want) > 60
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(make(spark, rows), bench).collect()}
    assert got == want


def test_main_text_rules():
    page = (
        '<body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><nav><ul><li><a href=x>Home</a></ul></nav>'
        '<main><article><h1>T</h1><p>One &lt;two&gt; a<b>b</b> 3 < 4<p>x &nbsp; y<div class="comments"><p>hi</p></div>'
        '<form><label>n</label></form><script>var t="</p>"</script><!-- <p>no</p> --><p>end &amp z</article></main><aside>s</aside><footer>f</footer>'
    )
    assert html_text.main_text(page) == "T One <two> ab 3 < 4 x y end & z"
    assert html_text.main_text(None) == html_text.main_text("") == ""
    prose_block = "<p>" + "The mill by the river is the oldest of the mills that stand in this part of the land. " * 2 + "</p>"
    plain = f"<body><ul><li><a href=a>One</a><li><a href=b>Two</a></ul>{prose_block}<p>Short one.</p>{prose_block}<p>(c) 2020</p></body>"
    got = html_text.main_text(plain)
    assert "Short one." in got and "Two" not in got


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, None, None), (None, "u", "<p>a</p>"), (1, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(0))
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.extract(df).collect())
    assert got == [("1", "", 0), ("1", "", 0), ("None", "a", 1)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_quality_on_held_out_rows(spark, monkeypatch):
    rng = random.Random(9)
    good = [(i, prose(rng, 60), 1) for i in range(160)]
    bad = [(200 + i, " ".join(["Buy!!! %%%"] * 20) if i % 2 else " ".join(["word"] * 40), 0) for i in range(60)]
    rows = [*good, *bad, (500, None, 1), (501, "", None), (None, "x", 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("score", F.lit(0))
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == len(rows)
    for i, _, q in [*good, *bad]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(i, q) for i, _, q in [*good, *bad] if got[i].held_out]
    assert sum(got[i].predicted == q for i, q in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_pipeline_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    rng = random.Random(11)
    texts = [(i, prose(rng, 90)) for i in range(60)]
    item = " ".join(texts[7][1].split()[10:50])
    rows = [*texts, (60, texts[3][1]), *((100 + i, " ".join(["Buy!!! %%%"] * 20)) for i in range(30))]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    left = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert left == set(range(61)) - {3, 7}


def test_pipeline_takes_nulls_repeats_and_empty_tables(spark, tmp_path):
    rng = random.Random(12)
    texts = [(i, prose(rng, 90)) for i in range(40)]
    rows = [*texts, (None, prose(rng, 80)), (None, None), (50, None), (51, ""), (3, texts[3][1]), (52, texts[5][1]), *((100 + i, " ".join(["Buy!!! %%%"] * 20)) for i in range(30))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, label string, chunk int"
    docs = spark.createDataFrame([(i, t, None, None, None, "x", 1) for i, t in rows], schema)
    labels = [(i, int(i < 100), None) for i, _ in rows if i is not None] + [(None, 1, 1), (7, None, 0)]
    bench = [(0, None), (1, ""), (None, " ".join(texts[9][1].split()[5:60]))]

    def tables(name, some):
        at = f"{tmp_path}/{name}"
        (docs if some else docs.limit(0)).write.parquet(f"{at}/documents.parquet")
        left = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        (left if some else left.limit(0)).write.parquet(f"{at}/labels.parquet")
        held = spark.createDataFrame(bench, "item_id long, text string")
        (held if some else held.limit(0)).write.parquet(f"{at}/benchmark.parquet")
        return at

    at = tables("some", True)
    step, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        step = common.written(stage(spark, step, at), "stage")
        kept[name] = step
        if name != "packing":
            assert step.columns == docs.columns
    left = {str(r.doc_id): r.text or "" for r in kept["decontamination"].collect()}
    # 5 is a copy of 52, 9 holds a benchmark item; of the rows without a text one stays at most
    assert left.keys() - {"None", "51"} == {str(i) for i in (*range(40), 52)} - {"5", "9"}
    assert left["52"] == texts[5][1] and left["None"] == rows[40][1]
    none = tables("none", False)
    assert corpus_pipeline.run(spark, none).count() == 0
    assert quality.fit(docs, spark.read.parquet(f"{none}/labels.parquet")).learned is False
    assert corpus_pipeline.keep_quality(spark, docs, none).count() == len(rows)


def test_registered():
    assert {re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES} == {str(n) for n in range(1, 11)}


def test_shared_folder_is_read_from_the_session(spark):
    assert common.shared_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


@pytest.mark.parametrize(
    ("page", "kept"),
    [
        ('<div id=page class="site has-sidebar">{}</div>', True), ('<div class="no-comments"><div class="with-ads">{}</div></div>', True),
        ('<div class="search-page"><article>{}</article></div>', True), ('<div class="widget"><main>{}</main></div>', True),
        ('<div class="comments"><article>{}</article></div>', False), ("<aside><main>{}</main></aside>", False),
        ('<div class="related-posts"><article>{}</article></div>', False), ('<article><div class="ad">{}</div></article>', False),
        ('<div class="left-sidebar">{}</div>', False), ('<div class="ad-slot">{}</div>', False),
    ],
)
def test_marks_of_wrappers_do_not_drop_the_article(page, kept):
    text = "The story of the town is told in this book and it was read by all of them for many years."
    assert html_text.main_text(page.format(f"<p>{text}</p>")) == (text if kept else "")


def test_a_very_long_text_ends_no_training(spark):
    free = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, "poor " * 4_900_000 if i == free[0] else ("good text " if i in free[20:] else "poor junk ") * 5) for i in free]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in free[20:])) for i in free], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    scorer = quality.Scorer(model)
    assert scorer.score("good text good text") > 0.5 > scorer.score("poor junk poor junk")


def test_a_text_of_millions_of_words(spark):
    rng = np.random.default_rng(1)
    names = np.array([f"w{i}" for i in range(50_000)])
    long = " ".join(names[rng.integers(0, len(names), 5_000_000)])
    flat, sizes = minhash_dedup.shingle_sets(pa.array([long, "a b c d", None]), 3)
    assert sizes.tolist() == [len(flat) - 2, 2, 0] and sizes[0] > 4_900_000
    whole = superminhash.signatures(flat, np.repeat(np.arange(3), sizes), 3, 240)
    parts = [superminhash.signatures(p, np.zeros(len(p), np.int64), 1, 240)[0] for p in np.array_split(flat[: sizes[0]], 3)]
    assert (whole[0] == np.minimum.reduce(parts)).all()
    df = make(spark, [(1, long), (2, long), (3, "a b c d")])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(df, shingle=3, percent=85).collect()}
    assert got == {1: (sizes[0], 1), 2: (sizes[0], 1), 3: (2, 3)}
    scores = quality.Scorer(quality.Model(rng.normal(size=quality.BUCKETS), 0.0)).scores(pa.array([long, long]))
    assert scores[0] == scores[1]


def test_scorer_against_plain_sums():
    rng = random.Random(2)
    model = quality.Model(np.random.default_rng(2).normal(size=quality.BUCKETS), 0.3)
    texts = [None, "", " \n", "one", "one one", "it is é ß \U0001f600 ok", *(prose(rng, n) for n in (2, 30, 400)), "one one"]
    got = quality.Scorer(model).scores(pa.array(texts))
    one_by_one = [quality.Scorer(model).score(t) for t in texts]
    assert got.tolist() == pytest.approx(one_by_one)
    for t, score in zip(texts, got, strict=True):
        w = [x.encode() for x in words(t)]
        each = [quality.word_features([x])[0] for x in w]
        numbers = [model.weights[f].sum() for f in each]
        hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in w], np.uint64)
        pairs = model.weights[quality.pair_features(hashes)].sum() if len(w) > 1 else 0.0
        n = sum(map(len, each)) + max(len(w) - 1, 0)
        logit = 0.3 + (sum(numbers) + pairs) / n if n else 0.3
        assert score == pytest.approx(1 / (1 + np.exp(-logit)))
    assert quality.word_features([b"ab"])[1].tolist() == [1 + 2 + 1]  # the word, <ab ab> and <ab>


def test_run_hashes_tell_runs_apart():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 3, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    from oddrank.llm import words as w

    for size in (1, 2, 3, 5, 30, 50):
        got = w.run_hashes(values, size)
        seen = {}
        for i in range(len(values) - size + 1):
            assert seen.setdefault(values[i : i + size].tobytes(), got[i]) == got[i]
        assert len(set(seen.values())) == len(seen)
    # sequences that polynomials modulo a power of two can't tell apart
    thue = np.array([i.bit_count() % 2 for i in range(1 << 12)], np.uint64)
    assert w.run_hashes(thue, 1 << 11)[0] != w.run_hashes(thue, 1 << 11)[1 << 11]
    assert len(w.run_hashes(values[:3], 5)) == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(21)
    base = [prose(rng, n) for n in (60, 90, 120, 7, 3)]
    rows = [(i, prose(rng, rng.randrange(5, 150))) for i in range(50)]
    for i, text in enumerate(base):  # exact copies, near copies, near copies of near copies
        w = text.split()
        changed = [*w[: len(w) // 2], "changed", *w[len(w) // 2 + 1 :]]
        again = [*changed[: len(w) // 4], "again", *changed[len(w) // 4 + 1 :]]
        rows += [(60 + 10 * i + k, t) for k, t in enumerate([text, text, " ".join(changed), " ".join(again), text.upper(), text + " end"])]
    rows += [(200 + i, " ".join(["Buy!!! %%%"] * rng.randrange(5, 30))) for i in range(40)] + [(300, ""), (301, None)]
    items = [(0, " ".join(rows[4][1].split()[:5])), (1, rows[9][1]), (2, " ".join(base[2].split()[30:70])), (3, "never said anywhere")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200)) for i, _ in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = str(tmp_path)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    model = quality.fit(docs, spark.read.parquet(f"{at}/labels.parquet"))
    good = [(i, t) for i, t in rows if quality.Scorer(model).score(t) >= quality.THRESHOLD]
    step = common.written(corpus_pipeline.keep_quality(spark, docs, at), "stage")
    assert ids(step) == sorted(i for i, _ in good) and not any(200 <= i < 240 for i, _ in good) and len(good) >= 70

    last = {}
    for i, t in good:
        last[t or ""] = max(i, last.get(t or "", -1))
    step = common.written(corpus_pipeline.drop_exact_copies(spark, step, at), "stage")
    single = [(i, t) for i, t in good if last[t or ""] == i]
    assert ids(step) == sorted(i for i, _ in single)

    step = common.written(corpus_pipeline.drop_near_copies(spark, step, at), "stage")
    apart = {i for i, _, c in brute_components(single, 5, 80) if c == i}
    assert ids(step) == sorted(apart) and len(apart) < len(single)

    left = [(i, t) for i, t in single if i in apart]
    step = common.written(corpus_pipeline.drop_benchmark(spark, step, at), "stage")
    leaked = {i for i, _ in brute_leaks(left, items)}
    assert leaked and ids(step) == sorted(apart - leaked)

    coder = tokens.encoder(tokens.default_tokenizer())
    wanted = {(i, k): x for i, t in left if i not in leaked for k, x in enumerate([*coder.ids(t).tolist(), 0])}
    got = {}
    for r in corpus_pipeline.pack_sequences(spark, step, at).collect():
        for k, x in enumerate(np.frombuffer(r.ids, "<u4").tolist()):
            assert got.setdefault((r.doc_id, r.start + k), x) == x
    assert got == wanted
