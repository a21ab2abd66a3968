"""Chat formatting, URL filters, toxicity, SentencePiece and the pipeline."""

import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from foldstone.llm import bloom, chat, queries, sentencepiece_fst, toxicity, url_filter
from tests import oracle

TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("module, query", [(chat, "op4_chat_format"), (url_filter, "op8_url_filter")])
def test_matches_sql(spark, sf_dir, module, query):
    oracle.same(getattr(module, query)(spark, sf_dir), oracle.connect(sf_dir), module.ORACLE_SQL)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "sentencepiece"]


# chat


def conversations(seed):
    r = random.Random(seed)
    bits = ["<turn:", "</turn>\n", "\\", "\\l", ">", "plain text", "é🙂", "\n", "<|x|>", ""]
    rows = []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, -1, "system", "".join(r.choices(bits, k=3))))
        for t in range(r.randrange(0, 40)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "".join(r.choices(bits, k=r.randrange(0, 60)))))
    return rows + [(50, 3, None, None), (50, 4, "assistant", None), (51, 0, "system", "alone"), (None, 1, "user", "q"), (None, None, "assistant", "a"), (52, 1, "assistant", "z" * 200000), (52, 2, "assistant", "same"), (52, 2, "assistant", "same"), (53, 0, "a>b<c\\", "odd role")]


def counted(text):
    return -(-len(text.encode()) // 4) + chat.OVERHEAD


def assert_within_budget(turns, n_context, span):
    if sum(counted(t) for _, t in turns) > span:
        assert len(turns) <= 2 and turns[0][0] == "system" or len(turns) == 1


@pytest.mark.parametrize("sizes", [[1200] * 30, [300 * 4 - 16] * 9, [4, 400, 900, 1500, 90, 2100, 30] * 12, [0] * 2500])
@pytest.mark.parametrize("system", [None, 0, 200])
def test_windows_keep_their_budget(spark, sizes, system):
    rows = [(1, t, "user" if t % 2 else "assistant", chr(97 + t % 26) * n) for t, n in enumerate(sizes, 1)]
    if system is not None:
        rows.append((1, -5, "system", "s" * system))
    made = sorted(chat.windows(spark.createDataFrame(rows, TURNS)).collect(), key=lambda w: w.window)
    own = []
    for w in made:
        turns = chat.parse(w.formatted)
        assert_within_budget(turns, w.n_context, chat.SPAN)
        own += turns[w.n_context :]
    assert own == [(role, text) for _, _, role, text in sorted(rows, key=lambda x: x[1])]
    # the history is there: all but the first window repeat what fits
    for w, before in zip(made[1:], made):
        last = chat.parse(before.formatted)[-1]
        turns = chat.parse(w.formatted)
        room = chat.SPAN - sum(counted(t) for role, t in turns)
        if w.n_context == (system is not None):
            assert counted(last[1]) > min(chat.HISTORY, room)


@pytest.mark.parametrize("span, history", [(64, 32), (64, 0), (512, 128)])
def test_windows_read_back(spark, span, history):
    rows = conversations(span + history)
    frame = spark.createDataFrame(rows, TURNS).withColumn("window", F.lit("clash"))
    made = chat.windows(frame, span, history)
    found = {r.conv_id: r for r in chat.digests(made).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(found) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        target = "".join(text for *_, role, text in turns if role == "assistant")
        r = found[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(target), hashlib.sha256(target.encode()).hexdigest())
    for w in made.collect():
        turns = chat.parse(w.formatted)
        if by[w.conv_id] and sorted(by[w.conv_id])[0][2] == "system":
            assert turns[0] == (sorted(by[w.conv_id])[0][2], sorted(by[w.conv_id])[0][3])
        repeated = [t for t in turns[: w.n_context] if t[0] != "system"]
        assert sum(-(-len(t[1].encode()) // 4) + chat.OVERHEAD for t in repeated) <= max(history, 0)
        assert len(w.loss) == sum(role == "assistant" for role, _ in turns[w.n_context :])
        assert_within_budget(turns, w.n_context, span)


def test_chat_limits(spark):
    assert chat.windows(spark.createDataFrame([], TURNS)).count() == 0
    with pytest.raises(ValueError):
        chat.windows(spark.createDataFrame([], TURNS), 10, 11)
    text = "\\### Assistant: </turn> ok<>\\l"
    assert chat.unescape(chat.escape(text)) == text and "<" not in chat.escape(text)


# URLs


def brute_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:end].translate({c: c + 32 for c in range(65, 91)})
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_url_rules_and_bloom(spark):
    r = random.Random(1)
    hosts = ["org", "example.org", "EXAMPLE.org", "a.b.example.org", "badexample.org", "com", "x.com", "com.", "", "ÄÖ.org", "user@h.com", "h.com:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/123/x", "/en/2", "/fr/a", "/de/", "/DE/", "/fr/?q=/de/", "?x", "#y", "/es/#z", "/é/"]
    urls = [f"{s}{r.choice(hosts)}{r.choice(paths)}" for s in ("http://", "https://", "", "x://y://", "://") for _ in range(60)] + [None, "", "no url", "http://a\nb.org/c\nd", "http://" + "a." * 300 + "org/" + "x" * 5000]
    pages = spark.createDataFrame([(i % 290, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("rule", F.lit("clash"))
    more = url_filter.RULES + [(f"h{k}.net", f"/p{k}/", "block") for k in range(3000)]
    for rules in (url_filter.RULES, more):
        found = url_filter.judge(pages, url_filter.rule_list(spark, rules)).collect()
        key = lambda x: tuple(map(str, x))
        assert sorted(map(tuple, found), key=key) == sorted(((i % 290, *brute_verdict(u, rules)) for i, u in enumerate(urls)), key=key)
    assert url_filter.judge(pages.where("false"), url_filter.rule_list(spark)).count() == 0
    empty = url_filter.rule_list(spark).where("false")
    assert {r.verdict for r in url_filter.judge(pages, empty, "block").collect()} == {"block"}


def test_url_list_with_many_lengths_of_paths(spark):
    r = random.Random(9)
    rules = [("site.net", "/" + "x" * n, "block") for n in range(400)] + [("net", "/" + "x" * 450, "allow"), ("other.net", "", "block"), ("net", "/y", "block")]
    urls = [f"http://{r.choice(['site.net', 'a.site.net', 'other.net', 'x.other.net', 'net', 'z.org'])}/{'x' * r.randrange(600)}{r.choice(['', 'y', '?q'])}" for _ in range(150)] + ["http://site.net", "http://b.net/yy"]
    found = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.rule_list(spark, rules)).collect()
    assert sorted(map(tuple, found)) == sorted((i, *brute_verdict(u, rules)) for i, u in enumerate(urls))


def test_bloom_filter_holds_all_that_was_added(spark):
    added = spark.range(20000).select(F.xxhash64("id").alias("h"))
    words = bloom.filter_words(added)
    others = spark.range(20000, 60000).select(F.xxhash64("id").alias("h")).toArrow().column(0).to_numpy()
    assert bloom.maybe(words, added.toArrow().column(0).to_numpy()).all() and bloom.maybe(words, others).mean() < 0.05
    assert not bloom.maybe(bloom.filter_words(added.where("false")), others).any()
    assert bloom.blocks_for(10**9) == bloom.MOST


# toxicity


def toxic_rows(n, seed):
    r = random.Random(seed)
    plain = ["".join(r.choice("aeioulnrst") for _ in range(r.randrange(3, 9))) for _ in range(600)]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(r.choices(plain, k=8)) for _ in range(r.randrange(1, 30))]
        bad = r.random() < 0.2
        if bad:
            at = r.randrange(len(sentences))
            sentences[at] += f" {r.choice(['grobnik', 'zuxvile', 'zuxvort'])}{r.choice(['', 's', plain[0]])}"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = toxic_rows(1500, 1)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    truth = dict(labels)
    held = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held)
    assert right / len(held) > 0.97
    texts = dict(rows)
    found = [texts[r.doc_id][s.start : s.end] for r in held for s in r.offending]
    assert found and all("grobnik" in s or "zuxv" in s for s in found)
    kept = {r.doc_id for r in toxicity.clean(docs.withColumn("score", F.lit("clash")), marks).collect()}
    assert sum(truth[i] for i in kept) < 0.1 * sum(truth.values()) and sum(1 - truth[i] for i in kept) > 0.99 * sum(1 - t for t in truth.values())


def test_training_step_by_brute_force():
    """The gradient against differences of the likelihood, over chunks and as a whole; the score against its formula."""
    r = np.random.default_rng(3)
    per_doc, toxic = r.integers(0, 5, 12), np.arange(12) % 3 == 0
    per_sentence = r.integers(0, 6, per_doc.sum())
    features = r.integers(0, 7, per_sentence.sum())
    w, bias = r.normal(size=7), -0.3

    def loss(w, bias):
        total, at, sentence = 0.0, 0, 0
        for n, bad in zip(per_doc, toxic):
            clean = 1.0
            for size in per_sentence[sentence : sentence + n]:
                clean *= 1 - 1 / (1 + math.exp(-bias - sum(w[f] for f in features[at : at + size])))
                at += size
            sentence += n
            total -= math.log(max(1 - clean, 1e-9)) if bad and n else math.log(clean)
        return total

    bags = toxicity.Bags(toxic.astype(int), per_doc, per_sentence, features)
    gw, gb = bags.gradient(w, bias)
    step = 1e-6
    assert gw == pytest.approx([(loss(w + step * e, bias) - loss(w - step * e, bias)) / (2 * step) for e in np.eye(7)], abs=1e-4)
    assert gb == pytest.approx((loss(w, bias + step) - loss(w, bias - step)) / (2 * step), abs=1e-4)
    cut, sentences = 5, per_doc[:5].sum()
    halves = [toxicity.Bags(toxic[:cut].astype(int), per_doc[:cut], per_sentence[:sentences], features[: per_sentence[:sentences].sum()]), toxicity.Bags(toxic[cut:].astype(int), per_doc[cut:], per_sentence[sentences:], features[per_sentence[:sentences].sum() :])]
    assert sum(h.gradient(w, bias)[0] for h in halves) == pytest.approx(gw)
    odds = [0.4, -2.0, -30.0]
    assert toxicity.noisy_or(odds) == pytest.approx(1 - math.prod(1 - 1 / (1 + math.exp(-z)) for z in odds))
    word = toxicity.Model(-1.0, {toxicity._features("bad")[0]: 3.0})
    assert [z for *_, z in word.sentences("Bad day. Good day! ...")] == [2.0, -1.0]


def test_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i} " * 20) for i in range(4000)] + [(50, "x" * 10**6)] + [(60, "same")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    assert toxicity.sampled(docs, labels, 25).count() == 25
    texts = [r.text for r in toxicity.sampled(docs, labels, 8000, 30_000).collect()]
    assert 0 < sum(map(len, texts)) <= 30_000
    assert toxicity.sampled(docs.where("doc_id = 60"), labels).count() <= 1


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "...!?"), (None, "a b"), (4, "w " * 100000), (4, "w")], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    for labels in ([], [(1, 1), (1, 0), (None, 1), (2, None)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        out = toxicity.score(docs, model).collect()
        assert len(out) == 6 and all(r.score == 0.0 for r in out)
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_toxicity_fit_gives_its_memory_back(spark):
    """After a fit on 12 MB of text the driver's Python holds nothing of the sample, neither arrays nor freed Arrow memory."""
    import pyarrow as pa

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(line.split()[1]) for line in f if line.startswith("Pss_Anon")) / 1024

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("sequence(1, 500)").alias("at"), "id")
    docs = docs.select("doc_id", F.array_join(F.transform("at", lambda n: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", n), F.lit(3000)), F.lit("x "))), "").alias("text"))
    marks = spark.range(3000).select(F.col("id").alias("doc_id"), F.pmod("id", F.lit(7)).eqNullSafe(0).cast("int").alias("toxic"))
    pa.default_memory_pool().release_unused()
    toxicity.fit(docs, marks)
    after = held()
    pa.default_memory_pool().release_unused()
    assert after - held() < 8
    assert pa.total_allocated_bytes() < 1 << 20


def test_toxicity_never_learns_from_held_out_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels).__getstate__() == toxicity.fit(docs, flipped).__getstate__()


# SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)


def test_encoding_and_decoding_match_the_library(library, sf_dir):
    t = sentencepiece_fst.Transducer.load(sentencepiece_fst.MODEL)
    r = random.Random(1)
    bits = ["a", "e", "the", "ing", " ", "  ", "   ", "\n", "\t", "é", "ß", "中", "日本", "🙂", "́", "▁", "A", "st", "_", "==", "0", "tion", "\x00", "ż", " " * 7]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(0, 14))) for _ in range(4000)] + ["x" * 3000, " ", "", "ab" * 2000]
    texts += [x[0] for x in oracle.connect(sf_dir).execute("SELECT text FROM documents UNION ALL SELECT html FROM pages").fetchall()]
    for text in texts:
        ids = t.encode(text).tolist()
        assert ids == library.encode(text)
        assert t.decode(ids) == library.decode(ids)
        if "▁" not in text:
            assert t.decode(ids) == text


def test_unigram_takes_the_lightest_path():
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("ab", -3.5, 1), ("▁a", -2.5, 1), ("ba", -9.0, 1)]
    t = sentencepiece_fst.Transducer(1, pieces, True)
    assert [pieces[i][0] for i in t.encode("ab")] == ["▁a", "b"]
    assert [pieces[i][0] for i in t.encode("abab")] == ["▁a", "b", "ab"]
    assert [pieces[i][0] for i in t.encode("az")] == ["▁a", "<unk>"]


def test_sentencepiece_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = sentencepiece_fst.op3_sentencepiece(spark, sf_dir).collect()
    assert len(out) == len(texts) and all(r.round_trip for r in out)
    for r in out:
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


def test_long_text_without_spaces_takes_linear_time(library):
    t = sentencepiece_fst.Transducer.load(sentencepiece_fst.MODEL)
    r = random.Random(2)
    text = "".join(r.choice("abcdefghijklmnop") for _ in range(1_000_000))
    began = time.time()
    ids = t.encode(text)
    assert time.time() - began < 60
    assert ids.tolist() == library.encode(text) and t.decode(ids.tolist()) == text


def test_each_part_is_searched_once_and_whole(library):
    t = sentencepiece_fst.Transducer.load(sentencepiece_fst.MODEL)
    searched, search = [], t.shortest
    t.shortest = lambda part: searched.append(part) or search(part)
    text = "ouéaieuxlepa éaiquement. Èonaiç éêêon\nAnè"
    assert t.encode(text).tolist() == library.encode(text)
    assert searched == ["▁ouéaieuxlepa", "▁éaiquement.", "▁Èonaiç", "▁éêêon", "\n", "Anè"]


def test_encoding_and_decoding_share_a_worker(spark, sf_dir):
    for df in (sentencepiece_fst.op3_sentencepiece(spark, sf_dir), corpus_pipeline.tokens(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "é▁\n\n  x"), (4, "some text"), (4, "y")], "doc_id long, text string")
    apart = sentencepiece_fst.decode(sentencepiece_fst.encode(docs))
    assert sorted(sentencepiece_fst.encode_decode(docs).collect(), key=str) == sorted(apart.collect(), key=str)


def test_decode_gives_texts(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (3, "é▁\n\n  x")], "doc_id long, text string")
    ids = sentencepiece_fst.encode(docs).select("doc_id", "ids", F.lit("clash").alias("n_tokens"))
    ids = ids.union(spark.createDataFrame([(4, None, "")], "doc_id long, ids array<int>, n_tokens string"))
    assert {r.doc_id: r.decoded for r in sentencepiece_fst.decode(ids).collect()} == {1: "some text", 2: "", 3: "é \n\n  x", 4: ""}


def test_sentencepiece_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "▁ a"), (None, "x"), (4, "word " * 60000), (4, "y")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = {r.doc_id: r for r in sentencepiece_fst.digests(sentencepiece_fst.decode(sentencepiece_fst.encode(docs))).collect()}
    assert out[1].n_tokens == out[2].n_tokens == 0 and all(r.round_trip for r in out.values())
    assert sentencepiece_fst.encode(docs.where("false")).count() == 0


# pipeline


def test_pipeline_stages_take_effect(spark, sf_dir):
    from foldstone.llm import mixing, shared

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, None
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, shared.stage(step(spark, docs, sf_dir), f"test-{name}")
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "toxicity":
            marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
            scored = toxicity.score(before, toxicity.fit(before, marks.select("doc_id", "toxic")))
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in scored.collect() if r.score < 0.5}
        if name == "line_dedup":
            assert docs.count() == before.count() and docs.where("n_chars <> char_length(text)").count() == 0
        if name == "simhash":
            assert docs.count() < before.count() and docs.exceptAll(before).count() == 0
        if name == "mixing":
            assert docs.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == mixing.mix(before).agg(F.sum("taken")).first()[0]
    assert docs.where("NOT round_trip").count() == 0 and docs.count() == before.count()
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, docs.collect()))
