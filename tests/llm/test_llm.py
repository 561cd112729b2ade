"""Operators against libraries and brute force, and the edge cases: nulls, empty and long texts, ties, repeated rows, empty
tables, columns with clashing names."""

import hashlib
import ipaddress
import random
import struct
import time
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestar.llm import bpe, htmltext, langid, media, neardup, packing, pii, simhash, tokencount, toxicity
from lodestar.llm.common import release, sieve

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, score string, bucket string, key string, length string"
BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "\n\n  x", "Don't we'll 'sofa", "<|endoftext|>x<|startoftext|>", "a" * 3000, "né É İΣς 漢字🙂 ²½", "\x1c a\x1d\x00b", "▁ ▁▁x  ▁", "x" * 200_000]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [*ODD, *(" ".join(rng.choices(words, k=rng.randint(1, 80))) + "." for _ in range(40))]
    rows = [(i, t, "en" if i % 3 else "de", "s", len(t), "a", "b", "c", "d", "e") for i, t in enumerate(texts)]
    rows += [rows[12], rows[13], (90, None, None, None, None, None, None, None, None, None), (None, texts[12], "en", "s", 1, "a", "b", "c", "d", "e"), (91, texts[12], "en", "s", 1, "a", "b", "c", "d", "e")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def texts_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_bpe_is_the_librarys(docs):
    library = Tokenizer.from_file(BYTE)
    expected = sorted((str(i), len(e.ids), hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()) for i, t in texts_of(docs) for e in [library.encode(t, add_special_tokens=False)])
    assert sorted((str(r[0]), *r[1:]) for r in bpe.round_trip(docs, BYTE).collect()) == expected
    back = bpe.decode(bpe.encode(docs, BYTE), BYTE)
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(repr((i, t)) for i, t in texts_of(docs))


def test_idle_workers_give_up_what_they_hold(spark, docs):
    def held_by(batches):
        from lodestar.llm import common

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._held)] * batch.num_rows, pa.int64())], names=["n"])

    expected = sorted(map(str, packing.pieces(docs, WORD).collect()))
    assert toxicity.clean(docs, toxicity.ToxicityModel(np.zeros(toxicity.BUCKETS, np.float32), -6.0)).count()
    time.sleep(2)
    assert spark.range(0, 64, 1, 64).mapInArrow(held_by, "n long").agg(F.max("n")).first()[0] == 0
    assert sorted(map(str, packing.pieces(docs, WORD).collect())) == expected


def test_a_released_tokenizer_is_gone():
    gone = weakref.ref(packing.encoder(WORD))
    gone().encode("some words")
    release()
    assert gone() is None


def test_forced_boundaries_are_in_no_token():
    own = bpe.codec(BYTE)
    parts = own.cut("naïve—text漢字".encode())
    assert b"".join(parts) == "naïve—text漢字".encode()
    assert not any(a[-1:] + b[:1] in t for a, b in zip(parts, parts[1:]) for t in own.bytes_of.values())


def test_token_counts_are_the_librarys(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    expected = sorted((str(i), len(t.encode()), len(library.encode(t)), len(library.encode(t)) > 4096) for i, t in texts_of(docs))
    for frequent in (400_000, 100, 0):  # all by broadcast, some, all by shuffle
        assert sorted((str(r[0]), *r[1:]) for r in tokencount.count_tokens(docs, PIECE, frequent=frequent).collect()) == expected
    table = {r["pre_token"]: r for r in tokencount.pre_token_table(docs, PIECE, entries=50).collect()}
    assert table["▁漢字🙂"]["n_docs"] == 1 and max(r["n_docs"] for r in table.values()) > 5


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        room = min((r for r in rooms if r >= n), default=None)
        if room is None:
            rooms.append(capacity - n)
        else:
            rooms[rooms.index(room)] = room - n
    return sorted(rooms)


def test_packing_is_best_fit_decreasing(docs):
    library = Tokenizer.from_file(WORD)
    rows = packing.pack_documents(docs, WORD, capacity=256).collect()
    ids = {}
    for i, t in texts_of(docs):
        ids.setdefault(i, []).append(library.encode(t, add_special_tokens=False).ids + [1])
    by_sequence = {}
    for r in rows:
        assert any(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] and len(x) == r["doc_tokens"] for x in ids[r["doc_id"]])
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r["length"] for r in rows) == sum(len(x) for own in ids.values() for x in own)
    assert sorted(256 - sum(n for _, n in p) for p in by_sequence.values()) == best_fit([r["length"] for r in rows], 256)


def test_plans_of_histograms():
    for seed in range(200):
        rng = random.Random(seed)
        capacity = rng.choice([16, 64, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
        used, seen = {}, {}
        for length, a, b, window, each, offset in packing.plan({n: lengths.count(n) for n in set(lengths)}, capacity):
            for k in range(a, b):
                w = window + (k - a) // each
                assert used.get(w, 0) == offset + (k - a) % each * length
                used[w] = used.get(w, 0) + length
                seen[length] = seen.get(length, 0) + 1
        assert seen == {n: lengths.count(n) for n in set(lengths)}
        assert sorted(capacity - u for u in used.values()) == best_fit(lengths, capacity)


def test_fingerprints_of_texts_and_edits(docs):
    rows = {r["doc_id"]: r for r in simhash.edited_fingerprints(docs.dropDuplicates(["doc_id"])).collect()}
    text = dict(texts_of(docs))
    order = sorted((i for i in text if i is not None), reverse=True) + [None]
    for i, after in zip(order, order[1:] + order[:1]):
        own, k = text[i], len(text[i]) // 3
        assert rows[i]["edited_sha256"] == hashlib.sha256((own[: len(own) - k] + text[after][:k]).encode()).hexdigest()
        assert rows[i]["n_chars"] == len(own)
        assert 0 <= rows[i]["near_next"] <= 1
    assert rows[12]["fingerprint"] == rows[91]["fingerprint"] == rows[None]["fingerprint"]
    assert rows[0]["fingerprint"] == "0" * 32
    assert simhash.edited_fingerprints(docs).count() == docs.count()
    for i in (0, 6, 12, 20):  # votes by the definition, in plain integers
        mask = (1 << 64) - 1
        words = [w for w in text[i].lower().split()]
        h = [xxhash.xxh3_64_intdigest(w.encode()) for w in words]
        votes, k = [0] * 128, min(3, len(h))
        for at in range(len(h) - k + 1 if k else 0):
            term = 0
            for x in h[at : at + k]:
                term = ((term ^ term >> 31) * int(simhash.MIX[0]) + x * int(simhash.MIX[1])) & mask
            mixed = b""
            for by in simhash.MIX[2:]:
                x = ((term ^ term >> 29) * int(by)) & mask
                mixed += (x ^ x >> 32).to_bytes(8, "little")
            votes = [v + (1 if mixed[b // 8] >> (7 - b % 8) & 1 else -1) for b, v in enumerate(votes)]
        assert int(rows[i]["fingerprint"], 16) == sum(1 << (127 - b) for b, v in enumerate(votes) if v > 0)
        other = int(rows[i]["edited_fingerprint"], 16) ^ int(rows[i]["fingerprint"], 16)
        assert rows[i]["near_edited"] == 1 - other.bit_count() / 128
    order_of = dict(zip(order, order[1:] + order[:1]))
    assert all(r["near_next"] == 1 - (int(r["fingerprint"], 16) ^ int(rows[order_of[i]]["fingerprint"], 16)).bit_count() / 128 for i, r in rows.items())


def test_fingerprints_over_many_buckets_are_the_same(docs):
    own = docs.dropDuplicates(["doc_id"])
    shown = lambda df: sorted(map(repr, map(tuple, df.collect())))
    few, many = simhash.with_next(own, 10**9, 1), simhash.with_next(own, 500, 30)
    follows = lambda df: sorted(str(r["doc_id"]) for r in df.where("helper = 0").collect())
    assert follows(few) == follows(many) and many.rdd.getNumPartitions() > 10
    expected = simhash.edited_fingerprints(own)
    with_more = simhash.fingerprinted(own, every=1)
    assert shown(with_more.drop("near_documents")) == shown(expected)
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in expected.collect()}
    for r in with_more.collect():
        n = sum((x ^ prints[r["doc_id"]]).bit_count() <= 3 for x in prints.values()) - 1
        assert r["near_documents"] == (None if r["doc_id"] is None else n)


def test_search_finds_all_within_the_radius(spark):
    rng = random.Random(5)
    found = [rng.getrandbits(128) for _ in range(60)]
    found += [x ^ sum(1 << b for b in rng.sample(range(128), k)) for x in found for k in (1, 3, 4)]
    df = spark.createDataFrame([(f"{x:032x}",) for x in found], "fingerprint string")
    got = {(r[0], r[1]) for r in simhash.search(df, df, 3).select("query_fp", "fingerprint").collect()}
    assert got == {(f"{a:032x}", f"{b:032x}") for a in found for b in found if (a ^ b).bit_count() <= 3}


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(langid.training_rows(docs))
    got = {r[0]: r for r in langid.predict(docs, model).collect()}
    held = [(r["doc_id"], r["lang"]) for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == y for i, y in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_edge_cases(docs, spark):
    model = langid.train(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == docs.count()
    undefined = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert {0, 1, 90} <= undefined
    assert langid.accepted(docs, model, 0.0).columns == docs.columns
    empty = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}


def test_texts_of_no_learned_language_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(langid.training_rows(docs))
    rng = random.Random(8)
    noise = [" ".join("".join(rng.choices(chars, k=rng.randint(2, 9))) for _ in range(n)) for chars in ("abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", "абвгдежзиклмнопрст", "漢字文語言學日本") for n in (10, 100, 1000)]
    foreign = ["kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw"]
    strange = spark.createDataFrame([(i, t) for i, t in enumerate(noise + foreign)], "doc_id long, text string")
    assert langid.accepted(strange, model, 0.0).count() == 0
    held = [(r["doc_id"], r["text"]) for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    short = [(i, " ".join(t.split()[3:15])) for i, t in held if len(t.split()) > 15]
    for real in (held, short):
        kept = langid.accepted(spark.createDataFrame(real, "doc_id long, text string"), model, 0.0).count()
        assert kept >= 0.98 * len(real)


def brute_components(texts, words, percent):
    sets = {}
    for i, t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t).encode().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    name = {i: i for i in sets if i is not None}
    changed = True
    links = [(a, b) for a in name for b in name if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(name[a], name[b])
            changed |= name[a] != low or name[b] != low
            name[a] = name[b] = low
    return sets, name


def test_near_duplicates_are_the_brute_force_ones(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    base = [rng.choices(words, k=60) for _ in range(6)]
    texts = [(0, ""), (1, None), (2, "one two"), (3, "ONE two"), (None, "one two"), (4, " ".join(base[0])), (5, " ".join(base[0]))]
    for i in range(10, 260):  # a group of near copies on both sides of the bound, and others
        own = list(base[0] if i % 2 else rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append((i, " ".join(own)))
    sets, name = brute_components([(i, t or "") for i, t in texts], 4, 80)
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 4, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == name
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) for r in got)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"] or r["doc_id"] is None) for r in got)


def test_blocks_of_a_large_bucket_find_the_links_between_components(spark):
    rng = random.Random(2)
    sets = {i: set(rng.sample(range(40), 20)) if i % 2 else set(range(100 + i % 5, 120 + i % 5)) for i in range(60)}
    members = spark.createDataFrame([(1, i, i) for i in sets], "key long, id long, component long")
    stored = spark.createDataFrame([(i, np.array(sorted(s), np.uint64).tobytes()) for i, s in sets.items()], "id long, shingles binary")
    got = {(r[0], r[1]) for r in neardup.links_in_blocks(members, stored, 80, block=7).collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(4)
    a, b = (np.unique(rng.integers(0, 1 << 62, 900).astype(np.uint64) << np.uint64(1)) for _ in range(2))
    both = np.unique(np.concatenate([a, b]))
    assert (neardup.merged(neardup.registers(a), neardup.registers(b)) == neardup.registers(both)).all()
    j = neardup.similarity(neardup.registers(a)[None], np.array([len(a)]), neardup.registers(both)[None], np.array([len(both)]))[0]
    assert abs(j - len(a) / len(both)) < 0.1


def test_bands_find_pairs_at_the_bound():
    """Pairs of exactly 80 %: none of some thousands shares no band, and about 0.8 of the registers agree."""
    rng = np.random.default_rng(12)
    equal, missed, n = 0.0, 0, 3000
    for _ in range(n):
        k = int(rng.integers(1, 30))  # 8k in common of 10k
        drawn = rng.integers(0, 1 << 63, 10 * k, dtype=np.uint64) * np.uint64(2)
        a, b = (neardup.registers(neardup.mixed(np.unique(x))) for x in (drawn[: 9 * k], np.concatenate((drawn[: 8 * k], drawn[9 * k :]))))
        equal += (a == b).mean()
        missed += not (neardup.band_keys(a) == neardup.band_keys(b)).any()
    assert missed == 0 and abs(equal / n - 0.8) < 0.005


def test_texts_outside_of_groups_are_not_shuffled(spark):
    """Of 400 texts two are copies; what is dealt out anew after the signatures is a small part of the rows."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "s") for i in range(399)] + [(399, " ".join(f"w7x{k}" for k in range(30)), "s")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stay = neardup.one_of_each(docs)
        assert sorted(map(tuple, stay.collect())) == sorted(rows[:399])
        assert 1 <= shuffled_texts(stay) <= 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled_texts(df) -> int:
    """Rows with a text that df's plan shuffled, once it has run."""

    def walk(plan) -> int:
        if plan.nodeName() == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if plan.nodeName().endswith("QueryStage"):
            return walk(plan.plan())
        own, below = plan.metrics().get("shuffleRecordsWritten"), plan.children()
        mine = own.get().value() if own.isDefined() and "text#" in plan.output().toString() else 0
        return mine + sum(walk(below.apply(i)) for i in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_a_sieve_lets_all_of_its_hashes_pass(spark):
    every = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    maybe = sieve(every.limit(0))
    assert every.where(maybe("h")).count() == 0
    found = spark.range(0, 20_000, 10).select(F.xxhash64("id").alias("h"))
    for most_bits, others in ((27, 500), (12, 18_000)):
        passed = every.where(sieve(found, most_bits)("h"))
        assert found.join(passed, "h", "left_anti").count() == 0
        assert passed.count() - 2000 <= others


def test_near_duplicates_edge_cases(docs, spark):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and 91 not in ids and None in ids
    # rows of one id with other texts are documents of their own; of repeated rows and copies one stays
    schema = "doc_id long, text string, row string, id string"
    rows = [(1, "a b c d e f", "x", "y"), (1, "u v w x y z", "x", "y"), (1, "u v w x y z", "x", "y"), (1, "A b c d e f", "z", "y"), (2, "u v w x y z", "x", "y")]
    rows += [(3, "", "x", "y"), (3, None, "x", "y"), (None, "u v w x y z", "x", "y"), (None, "u v w x y z", "x", "y")]
    stay = neardup.one_of_each(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r["text"].lower() for r in stay if r["doc_id"] == 1) == ["a b c d e f", "u v w x y z"]
    assert sorted(str(r["doc_id"]) for r in stay) == ["1", "1", "3", "3", "None", "None"]
    assert neardup.one_of_each(spark.createDataFrame([], schema)).collect() == []
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_toxicity_learns_sentences_from_documents(spark):
    rng = random.Random(1)
    fine = ["".join(rng.choice("aeioulmnr") for _ in range(4)) for _ in range(200)]
    rows = []
    for i in range(700):
        sentences = [" ".join(rng.choices(fine, k=8)) for _ in range(6)]
        if i % 3 == 0:
            sentences[rng.randrange(6)] += " zzbad"
        rows.append((". ".join(sentences) + ".", int(i % 3 == 0)))
    model = toxicity.fit_calibrated(rows[:500])
    assert np.mean([(model.score(t) >= 0.5) == y for t, y in rows[500:]]) > 0.97
    text = rows[510][0]
    (a, b, _), *_ = sorted(model.locate(text), key=lambda x: -x[2])
    assert "zzbad" in text[a:b]


def test_toxicity_edge_cases(docs, spark):
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    some = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (5, None), (6, 1)], "doc_id long, toxic int"))
    for model in (none, some):
        got = toxicity.score(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
        assert {r["score"] for r in got if r["doc_id"] in (0, 1, 90)} == {0.0}
        assert toxicity.clean(docs, model).columns == docs.columns


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="ad">Buy this now please</div>
<div id="cookie-notice">We use cookies</div><div class="post"><h1>A &amp; B</h1><p>First   paragraph of a <b>long</b> enough
text.<p>Second one &eacute;.</p><form><p>Mail</p></form></div><aside>Side</aside><div class="comments"><p>I like it very much</p></div>
<footer>&copy; me</footer></body></html>"""


def test_html_main_text(spark):
    text = "A & B\nFirst paragraph of a long enough text.\nSecond one é."
    assert htmltext.main_text(PAGE) == text
    for broken in ("", None, "<", "<p", "plain text", "<div " * 3000, "</p></div>", "<a href='x'>only</a>", "<!-- open", "<script>x"):
        assert isinstance(htmltext.main_text(broken), str)
    assert htmltext.main_text("<b>" * 20_000 + "deep") == "deep"
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x")], "page_id long, url string, html string, text string")
    assert sorted(map(repr, map(tuple, htmltext.extract(pages).collect()))) == sorted(map(repr, [(1, "u", text, len(text)), (1, "u", text, len(text)), (2, None, "", 0), (None, "v", "", 0)]))


def test_html_wrappers_with_boilerplate_names_keep_the_article():
    text = "\n".join(f"Paragraph {i} of the article, which is long enough to be the text of the page." for i in range(6))
    article = "".join(f"<p>{x}</p>" for x in text.split("\n"))
    aside = '<div class="sidebar"><p>Weather today</p></div><div class="comments"><p>I like it very much</p></div>'
    for name in ("content-sidebar-wrap", "site-content no-sidebar", "has-sidebar", "comments-open", "share-enabled", "page menu", "promo"):
        assert htmltext.main_text(f'<body><div class="{name}"><div class="post">{article}</div>{aside}</div></body>') == text
        assert htmltext.main_text(f'<body><div class="{name}"><article>{article}</article>{aside}</div></body>') == text
    assert htmltext.main_text(f"<body><form><div>{article}</div>{aside}</form></body>") == text
    readers = f'<div class="comments">{"<article><p>Readers wrote this comment of some length.</p></article>" * 30}</div>'
    assert htmltext.main_text(f"<body><div class='sidebar-page'><article>{article}</article></div>{readers}</body>") == text
    assert htmltext.main_text(f"<body><div class='post'>{article}</div>{readers.replace('article', 'div')}</body>") == text


def test_html_probes_of_wrappers_and_of_renamed_elements():
    text = "\n".join(f"Paragraph {i} of the article, which is long enough to be the text of the page." for i in range(6))
    article = "".join(f"<p>{x}</p>" for x in text.split("\n"))
    names = "has-sidebar no-sidebar nav-open social-story with-ads share-enabled comment-enabled related-work".split()
    for name in names:
        for tag in ("article", "div", "section"):
            assert htmltext.main_text(f'<body><div class="{name}"><{tag}>{article}</{tag}></div></body>') == text
    links = "<ul>" + "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(9)) + "</ul>"
    unnamed = f"<body><div>{links}</div><div>Buy this</div><div>{article}{links}</div><div>{links}</div></body>"
    assert htmltext.main_text(unnamed) == text
    assert htmltext.main_text("<body><h1>Title</h1><p>One.<p>A longer second paragraph.<footer>me</footer>") == "Title\nOne.\nA longer second paragraph."


def test_html_of_renamed_pages_is_the_same(spark):
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        other = row["html"].replace("<article", "<div").replace("</article", "</div")
        assert htmltext.main_text(row["html"]) == htmltext.main_text(other) != ""


def brute_densities(node, body_chars, body_links):
    """(tag, density, density sum) of a node and all below it, by the definition, each count by its own recursion."""
    below = lambda x: [y for p in x.parts if isinstance(p, htmltext.Node) and not p.dropped for y in (p, *below(p))]
    chars = lambda x: sum(len(" ".join(p.split())) for y in (x, *below(x)) for p in y.parts if isinstance(p, str))

    def above(x):
        return [x.parent, *above(x.parent)] if x.parent else []

    def links(x):
        if x.tag == "a":
            return chars(x), len(below(x)) + 1
        found = [y for y in below(x) if y.tag == "a" and not any(a.tag == "a" for a in above(y))]
        return sum(map(chars, found)), sum(len(below(y)) + 1 for y in found)

    def density(x):
        c, t, (lc, lt) = chars(x), max(1, len(below(x))), links(x)
        if not c:
            return 0.0
        base = np.log(np.log(c / max(1, c - lc) * max(1, lc) + body_links / max(1, body_chars) * c + np.e))
        return c / t * np.log(max(1.0, c / max(1, lc) * t / max(1, lt))) / base

    everything = [node, *below(node)]
    return [(x.tag, density(x), sum(density(p) for p in x.parts if isinstance(p, htmltext.Node) and not p.dropped)) for x in everything]


def test_html_densities_are_the_definitions():
    for page in (PAGE, "<body><div>a <a href=x>b <b>c</b></a> d</div><p>one two three</p></body>", "<p>x<div><i>y</i> z zz</div>"):
        root = htmltext.parse(page)
        htmltext.leave_out(root)
        nodes, body = htmltext.densities(root)
        expected = brute_densities(root, body.chars, body.link_chars)
        assert [x.tag for x in nodes] == [t for t, _, _ in expected]
        assert np.allclose([x.density for x in nodes], [d for _, d, _ in expected])
        assert np.allclose([x.total for x in nodes], [s for _, _, s in expected])


def test_html_reading_is_linear():
    began = time.perf_counter()
    for part in ("<div ", "<div class='x>", "<b>", '<a href="', "<i></b>", "</p>", "<li>"):
        assert isinstance(htmltext.main_text(part * (400_000 // len(part))), str)
    assert time.perf_counter() - began < 20


def test_media_round_trip(docs):
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 5, 17, 96, 97):
        payload = rng.integers(0, 256, 192 * n, dtype=np.uint8).tobytes()
        file = media.write_avi(payload)
        assert b"".join(f.tobytes() for f in media.read_avi(file)[0]) == payload
        assert len(media.read_avi(file)[0]) == -(-n // 4)  # one size of frame, whatever divides the length
    still = [*np.full((9, 768), 20, np.uint8), *np.full((4, 768), 200, np.uint8), np.full(192, 200, np.uint8)]
    assert media.shots(still) == [(0, 9), (9, 14)]
    for r in media.media_digests(docs).collect():
        text = dict(texts_of(docs))[r["doc_id"]].encode()
        whole = text + b" " * (max(1, -(-len(text) // 192)) * 192 - len(text))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-16:]))


def canonical(lengths):
    """Code strings of symbols by (length, symbol), in order."""
    code, last, out = 0, 0, {}
    for length, symbol in sorted(lengths):
        code <<= length - last
        out[symbol], code, last = f"{code:0{length}b}", code + 1, length
    return out


def huffman_segment(number, lengths):
    by_length = [[s for n, s in sorted(lengths) if n == k] for k in range(1, 17)]
    return media.segment(0xC4, bytes([number, *map(len, by_length), *(s for x in by_length for s in x)]))


def grey_frame(coefficients, columns, quantiser, dc_lengths, ac_lengths, restart=0):
    """A baseline frame of blocks of 64 quantised coefficients in scan order, by another encoder than the engine's."""
    dc, ac = canonical(dc_lengths), canonical(ac_lengths)

    def amount(v):
        return "" if v == 0 else f"{v if v > 0 else v + (1 << abs(v).bit_length()) - 1:0{abs(v).bit_length()}b}"

    parts, bits, last = [], "", 0
    for b, block in enumerate(coefficients):
        if restart and b and b % restart == 0:
            parts, bits, last = [*parts, bits], "", 0
        bits += dc[abs(block[0] - last).bit_length()] + amount(block[0] - last)
        last, run = block[0], 0
        for v in block[1:]:
            if v == 0:
                run += 1
                continue
            while run > 15:
                bits, run = bits + ac[0xF0], run - 16
            bits, run = bits + ac[run << 4 | abs(v).bit_length()] + amount(v), 0
        if run:
            bits += ac[0]
    scans = []
    for part in [*parts, bits]:
        part += "1" * (-len(part) % 8)
        scans.append(bytes(int(part[i : i + 8], 2) for i in range(0, len(part), 8)).replace(b"\xff", b"\xff\0"))
    scan = b"".join(s + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(scans) else b"") for i, s in enumerate(scans))
    rows = len(coefficients) // columns
    head = media.segment(0xDB, bytes([0, *quantiser])) + media.segment(0xC0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 1) + bytes([1, 0x11, 0]))
    head += huffman_segment(0x00, dc_lengths) + huffman_segment(0x10, ac_lengths)
    head += media.segment(0xDD, struct.pack(">H", restart)) if restart else b""
    return b"\xff\xd8" + head + media.segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"


def test_media_decodes_frames_with_other_tables_and_ac_values():
    rng = random.Random(4)
    order = []  # the zigzag, walked
    r = c = 0
    for _ in range(64):
        order.append((r, c))
        if (r + c) % 2 == 0:
            r, c = (r + 1, c) if c == 7 else (r, c + 1) if r == 0 else (r - 1, c + 1)
        else:
            r, c = (r, c + 1) if r == 7 else (r + 1, c) if c == 0 else (r + 1, c - 1)
    coefficients = [[rng.randint(-30, 30)] + [rng.choice([0] * 9 + [rng.randint(-7, 7)]) for _ in range(63)] for _ in range(6)]
    coefficients[3][1:] = [0] * 62 + [5]
    quantiser = [rng.randint(1, 9) for _ in range(64)]
    sizes = [(2 + (i > 1) + (i > 3) * 2, i) for i in range(9)]
    pairs = sorted({(run << 4 | n) for run in range(16) for n in range(1, 4)} | {0, 0xF0})
    lengths = [(4 if s in (0, 1, 2, 17) else 8, s) for s in pairs]
    for restart in (0, 2):
        frame = grey_frame(coefficients, 3, quantiser, sizes, lengths, restart)
        (got, *_), rate, counted = media.read_frames(media.avi([frame, frame], 24, 16, 2 * 384))
        whole = got.reshape(16, 24)
        for b, block in enumerate(coefficients):
            f = {order[i]: v * quantiser[i] for i, v in enumerate(block)}
            scale = lambda u: 0.5**0.5 if u == 0 else 1.0
            for y in (0, 3, 7):
                for x in (0, 4, 7):
                    value = 128 + sum(scale(u) * scale(v) / 4 * s * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for (v, u), s in f.items())
                    assert abs(float(whole[b // 3 * 8 + y, b % 3 * 8 + x]) - min(255, max(0, value))) <= 0.51
    flat = [[rng.randint(-100, 100)] + [0] * 63 for _ in range(5)]  # fixed widths, other tables than the writer's
    fixed = grey_frame(flat, 5, [16] * 64, [(9 - i, i) for i in range(9)][::-1], [(2, 0)])
    assert media.Head(fixed).fixed is not None
    assert media.read_frames(media.avi([fixed], 40, 8, 5))[0][0].tolist() == [min(255, max(0, 2 * b[0] + 128)) for b in flat]


def test_media_that_cannot_be_read_gives_a_row_with_the_reason(spark):
    good = media.write_avi(b"x" * 192 * 9)
    broken = [good, None, b"", b"RIFF", good[:300], good[:-40], good.replace(b"\xff\xc0", b"\xff\xc2"), good.replace(b"\xff\xc4", b"\xff\xef")]
    df = spark.createDataFrame(list(enumerate(broken)), "doc_id long, media binary")
    got = sorted(media.clips(df).collect())
    assert [r["doc_id"] for r in got] == list(range(len(broken)))
    assert got[0]["error"] is None and got[0]["mean"] == 120.0 and all(r["error"] and r["clip"] is None for r in got[1:])


def test_media_shots_are_the_definitions():
    rng = np.random.default_rng(8)
    for _ in range(20):
        frames = [rng.integers(lo, lo + 40, rng.integers(10, 50)).astype(np.uint8) for lo in rng.choice([0, 100, 200], 30)]
        cuts, d = [0], []
        for a, b in zip(frames, frames[1:]):
            share = lambda f, k: sum(1 for v in f.tolist() if v // 8 == k) / len(f)
            d.append(sum(abs(share(a, k) - share(b, k)) for k in range(32)) / 2)
        for i, x in enumerate(d):
            w = d[max(0, i - 8) : i]
            mean = sum(w) / len(w) if w else 0.0
            deviation = (sum((v - mean) ** 2 for v in w) / len(w)) ** 0.5 if w else 0.0
            if x >= 0.15 and (not w or x > mean + 3 * deviation + 1e-9):
                cuts.append(i + 1)
        assert [a for a, _ in media.shots(frames)] == cuts


PRIVATE = [
    (1, "Write to of.55@mail9.example.com or call +1 (743) 555-3824, IP 227.5.221.1. Card 4111 1111 1111 1111!"),
    (2, "of.55@mail9.example.com again; token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907f1\", 078-05-1120"),
    (3, "Mrs Anna Miller met Mr Miller; Herr Weiß; господин Иванов"),
    (4, "nothing private here, version 1.2 and 3 apples"),
    (5, None),
    (None, "of.55@mail9.example.com"),
]


def test_surrogates_keep_form_and_identity(spark):
    df = spark.createDataFrame(PRIVATE, "doc_id long, text string").withColumn("entity", F.lit("x"))
    got = {r["doc_id"]: r for r in pii.surrogates(df).collect()}
    for private in ("of.55@", "555-3824", "227.5.221.1", "4111 1111", "24be6443", "078-05", "Anna", "Miller", "Weiß", "Иванов"):
        assert not any(private in r["text"] for r in got.values())
    mail = got[None]["text"]
    assert mail in got[1]["text"] and mail in got[2]["text"] and mail.endswith(".com")
    assert got[4]["text"] == PRIVATE[3][1] and got[4]["n_entities"] == 0 and got[5]["text"] == ""
    card = "".join(c for c in got[1]["text"].split("Card ")[1] if c.isdigit())
    digits = [int(c) for c in card][::-1]
    assert sum(digits[0::2] + [sum(divmod(2 * d, 10)) for d in digits[1::2]]) % 10 == 0
    names = got[3]["text"].split()
    assert names[0] == "Mrs" and names[1].endswith("a") and names[2] == names[5].rstrip(";")
    assert "".join(c for c in got[3]["text"] if "а" <= c.lower() <= "я").startswith("господин")
    assert pii.with_surrogates(df).columns == df.columns


def iban_fits(text):
    compact = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def test_surrogates_of_names_numbers_and_scripts(spark):
    texts = [
        "Mrs Anna Miller met Mr Jones; later Miller said that Anna and MILLER-like things differ. Millerton stays.",
        "Mr Miller came. Mr Smith-Jones and Mr O'Brien too.",
        "господин Иванов и госпожа Анна Иванова; Иванова сказала, Иванов ушёл.",
        "Mr 王小明 and Mrs 김미영; 王小明 left",
        "hosts 2001:db8::ff00:42:8329 and fe80::1 at 12:30:45, std::vector, a::b",
        "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432, wrong DE88370400440532013000",
        "a \ue000 mark \ue000# and \ue000! of 10.1.2.3 \ue000",
        "Dr MILLER spoke.",
        "Nobody here: Miller without a title, Иванова",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.surrogates(df).collect()}
    out = {i: r["text"] for i, r in got.items()}
    first = out[0].split()
    family, given = first[2], first[1]
    assert given.endswith("a") and family[0].isupper() and "Anna" not in out[0] and "Miller " not in out[0] and "Jones" not in out[0]
    assert out[0] == f"Mrs {given} {family} met Mr {first[5]} later {family} said that {given} and MILLER-like things differ. Millerton stays."
    assert out[1].startswith(f"Mr {family} came. Mr ") and out[1].count("-") == 1 and out[7] == f"Dr {family.upper()} spoke."
    man, woman = out[2].split()[1], out[2].split()[5].rstrip(";")
    assert woman == man + "а" and man.endswith("ов") and out[2].split()[4].endswith("а") and out[2].count(woman) == 2 and "Иван" not in out[2]
    han, hangul = out[3].split()[1], out[3].split()[4].rstrip(";")
    assert all("\u4e00" <= c <= "\u9fff" for c in han) and len(han) == 3 and all("\uac00" <= c <= "\ud7a3" for c in hangul) and out[3].split()[5] == han
    assert "2001:db8" not in out[4] and "fe80::1 " not in out[4] and out[4].endswith("at 12:30:45, std::vector, a::b") and got[4]["n_entities"] == 2
    ipaddress.ip_address(out[4].split()[1])
    good, other, bad = out[5][5:].replace(" wrong", "").split(", ")
    assert iban_fits(good) and good.startswith("DE") and good.count(" ") == 5 and iban_fits(other) and other[4:8].isalpha() and not iban_fits(bad[-22:])
    assert out[6].startswith("a \ue000 mark \ue000# and \ue000! of ") and "10.1.2.3" not in out[6] and out[8] == texts[8]


def test_short_addresses_all_get_surrogates_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(pii, "DRAWS", 1)  # for time: the form is too full for any number of draws
    own = [f"{a}@{b}.co" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrs"][:475]
    found = [r["text"] for r in pii.surrogates(spark.createDataFrame([(i, e) for i, e in enumerate(own)], "doc_id long, text string")).collect()]
    assert len(set(found)) == 475 and not set(found) & set(own) and all(f.endswith(".co") for f in found)


def test_colliding_surrogates_are_drawn_again(spark, monkeypatch):
    real = pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda e, key, draw: F.when(draw == 0, F.lit("9.9.9.9")).otherwise(real(e, key, draw)))
    df = spark.createDataFrame([(i, f"host 10.0.0.{i} up") for i in range(1, 8)], "doc_id long, text string")
    for rows in (1000, 2):
        monkeypatch.setattr(pii, "LITERAL_ROWS", rows)
        found = [r["text"] for r in pii.with_surrogates(df).collect()]
        assert len(set(found)) == 7 and sum("9.9.9.9" in t for t in found) == 1


def test_full_forms_get_wider_surrogates(spark, monkeypatch):
    monkeypatch.setattr(pii, "DRAWS", 1)  # for time: the addresses fill their form at any number
    own = [f"+100{i}" for i in range(10)] + [f"{i // 10}@{i % 10}.com" for i in range(100)]
    df = spark.createDataFrame([(i, f"id {e} end") for i, e in enumerate(own)], "doc_id long, text string")
    found = [r["text"].split()[1] for r in pii.with_surrogates(df).collect()]
    assert len(set(found)) == len(own) and not set(found) & set(own)
    assert all(f.startswith("+1") if e.startswith("+") else f.endswith(".com") for e, f in zip(own, sorted(found, key=lambda f: "@" in f)))
    local = spark.createDataFrame([(1, "ring +15551234567 now")], "doc_id long, text string")
    assert not pii.with_surrogates(local).first()["text"].startswith("ring +1555123")


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "personal_data", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, own, SF)
        assert after.columns == docs.columns
        after.write.parquet(str(tmp_path / name))
        own = spark.read.parquet(str(tmp_path / name))
        assert own.count() > 0.6 * docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, own, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in own.select("doc_id").collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, packed.collect()))


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    frames = [bpe.round_trip(none, BYTE), simhash.edited_fingerprints(none), toxicity.score(none, toxicity.fit([])), media.media_digests(none), pii.surrogates(none), tokencount.count_tokens(none, PIECE), packing.pack_documents(none, WORD)]
    assert [f.count() for f in frames] == [0] * len(frames)
