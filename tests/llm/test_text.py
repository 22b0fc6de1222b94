"""Text operators: byte-level BPE, PII, license scans, the quality classifier and near-duplicates."""

import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from mzframe.llm import byte_bpe, license_scan, near_dedup, pii, queries, weak_labels
from mzframe.llm.license_templates import TEMPLATES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, rep long, tokens long"


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", len(t or ""), 0.5, True, 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def coder():
    path, pattern = queries.tokenizer()
    with open(path, "rb") as f:
        return byte_bpe.Coder(f.read(), pattern), path, pattern


@pytest.fixture(scope="module")
def tiktoken_encoding(coder):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(coder[1], "rb"))}
    return tiktoken.Encoding("own", pat_str=coder[2], mergeable_ranks=ranks, special_tokens={})


# byte-level BPE


def stitched(coder, text, chunk, overlap):
    parts = [(byte_bpe.chunk_part(coder, c, at, last), last) for at, c, last in byte_bpe.chunks(text, chunk, overlap)]
    cut = [(byte_bpe.trimmed(p, overlap), last) for p, last in parts]
    whole, kept = (b"".join(byte_bpe.stitch(coder, iter(x))) for x in (parts, cut))
    assert whole == kept
    return np.frombuffer(whole, "<u4").tolist()


def test_stitched_chunks_equal_the_library(coder, tiktoken_encoding):
    c, random_ = coder[0], random.Random(1)
    for letters in ("ab é  \n\t'sre12中!?​\x1c", "aaaaaaaaaaab ", "   \n\n\n\n\n   a", "''''''''''srell ve", "!!!!!!!!.,a\U0001f600"):
        for overlap in (3, 8, 50):
            for size in (0, 1, 40, 300):
                for _ in range(20):
                    s = "".join(random_.choice(letters) for _ in range(size))
                    assert stitched(c, s, 20, overlap) == tiktoken_encoding.encode_ordinary(s)


def test_usual_texts_have_several_chunks_and_equal_the_library(coder, tiktoken_encoding):
    import duckdb

    texts = [t or "" for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    assert sum(len(list(byte_bpe.chunks(t, 1_024, 64))) > 1 for t in texts) > len(texts) / 2
    for t in texts:
        assert stitched(coder[0], t, 1_024, 64) == tiktoken_encoding.encode_ordinary(t)


def test_a_run_of_ten_million_letters_is_coded_once(coder):
    """Linear in the run: every chunk is looked at once, and the run once more when it closes."""
    c, seen = coder[0], []
    counted = byte_bpe.Coder.__new__(byte_bpe.Coder)
    counted.memo, counted.bytes, counted.piece = {}, c.bytes, lambda p: seen.append(len(p)) or c.piece(p)
    counted.find, counted.decode = c.find, c.decode
    text = "start " + "abcdefghij" * 1_000_000 + " end"
    parts = ((byte_bpe.chunk_part(counted, t, at, last), last) for at, t, last in byte_bpe.chunks(text, 65_536, 64))
    ids = b"".join(byte_bpe.stitch(counted, parts))
    assert c.decode(ids).decode() == text and sum(seen) < 2.1 * len(text)


def test_digests_of_whole_texts(spark, coder, tiktoken_encoding):
    texts = ["", None, "hello world", "hello world", "It's 12 naïve  tests\n\n!", " ", "x" * 5000, "word and word, " * 300, "\U0001f600" * 700]
    df = docs(spark, texts)
    ranks = byte_bpe.load_ranks(spark, coder[1])
    got = {r["doc_id"]: r for r in byte_bpe.encode(df, ranks, coder[2], byte_bpe.digests, byte_bpe.DIGESTS, chunk=512, overlap=64, dealt=1500).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = tiktoken_encoding.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = byte_bpe.encode(df, ranks, coder[2], byte_bpe.token_ids, "ids array<long>")
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in byte_bpe.decode(encoded, ranks, coder[2]).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert byte_bpe.encode(df.limit(0), ranks, coder[2], byte_bpe.digests, byte_bpe.DIGESTS).count() == 0


# personal data


def test_base_spans_equal_the_patterns():
    import re

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    keep = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15}
    random_ = random.Random(2)
    for _ in range(4000):
        s = "".join(random_.choice("a1.@+- 25()x%0é") for _ in range(random_.randint(1, 60)))
        assert pii.find(s) == {k: [m.span() for m in re.finditer(p, s) if keep[k](m[0])] for k, p in patterns.items()}


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("hein.19 [at] mail5 [dot] example [dot] com", "email"),
        ("hein.19 at mail5 dot example dot com", "email"),
        ("hеin.19@mаil5.example.com", "email"),
        ("h\u200bein@example.com", "email"),
        ("+one seven four three five five five three eight two four", "phone"),
        ("plus one (743) five five five three eight two four", "phone"),
        ("１９２.１６８.１.１", "ip"),
        ("one nine two dot one six eight dot one dot seven", "ip"),
        ("four five three nine one four eight eight zero three four three six four six seven", "card"),
    ],
)
def test_disguised_data_is_mapped_back_to_the_source(text, kind):
    _, every = pii.search(f"é so {text}, und so")
    assert (5, 5 + len(text)) in every[kind]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("jane.doe at example.com", "email"),
        ("jane_doe at mail.example.com", "email"),
        ("j4ne at example.com", "email"),
        ("+1 five 55 two 12 nine 00", "phone"),
        ("+1 five (55) two 12 nine 00", "phone"),
    ],
)
def test_disguises_behind_the_gates_are_found(text, kind):
    _, every = pii.search(f"é so {text}, und so")
    assert (5, 5 + len(text)) in every[kind]
    assert pii.redact(text, pii.search(text)[1]) == f"<{kind.upper()}>"


def test_the_trigger_rejects_nothing_that_is_rewritten():
    random_ = random.Random(12)
    words = ["one", "zwei", "NUEVE", "7", "55", "dot", "dash", "plus", "at", "x.y", "a_b", "word", "oneself", "(", ")", "-", ",", ".", " ", " ", "  ", "\n", "[at]", "{ dot }", "\u200b", "@", "é"]
    for _ in range(20_000):
        text = "".join(random_.choice(words) + random_.choice(["", " "]) for _ in range(random_.randint(1, 12)))
        assert pii.TRIGGER.search(text) or not pii.edits(text), text
    for text in ("We stopped. At example.com they wait", "he was here. at example.com", "look at example.com"):
        assert not any(pii.search(text)[1].values())


def test_prose_is_left_alone_and_base_spans_stay():
    for text in ("Meet me at noon by the dot at the end", "one and two and three", "look at example.com", "a (at) b", None, ""):
        assert not any(pii.search(text)[1].values())
    base, every = pii.search("mail x@y.com or z (at) y (dot) com, ip 1.2.3.4")
    assert all(set(base[k]) <= set(every[k]) for k in base) and len(every["email"]) == 2


def test_detection_and_redaction_over_a_table(spark):
    texts = ["call +1 (743) 555-3824 or x@y.com", None, "", "4539 1488 0343 6467", "x" * 20000 + " 1.2.3.4"]
    got = {r["doc_id"]: r for r in pii.detect(docs(spark, texts)).collect()}
    assert [got[i]["n_phone"] for i in range(5)] == [1, 0, 0, 0, 0] and got[4]["spans"] == "ip:20001:20008" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[0]["base_sha256"] == hashlib.sha256(got[0]["spans"].encode()).hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(docs(spark, texts)).collect()}
    assert clean[0] == "call <PHONE> or <EMAIL>" and clean[1] is None and clean[3] == "<CARD>"
    assert pii.detect(docs(spark, texts).limit(0)).count() == 0


# license scans


def test_scan_finds_what_brute_force_finds():
    scanner, random_ = license_scan.Scanner(TEMPLATES, 0.8, 44), random.Random(3)
    noise = [f"w{k}" for k in range(500)]
    for _ in range(40):
        name = random_.choice(list(TEMPLATES))
        words = TEMPLATES[name].split()
        for k in range(len(words) // 40):
            words[random_.randrange(len(words))] = f"z{k}"
        text = " ".join(random_.choices(noise, k=random_.randint(0, 300)) + words + random_.choices(noise, k=random_.randint(0, 300)))
        shingles, _ = scanner.words.shingles(text)
        want = set()
        for span, held in scanner.by_span.items():
            for other, s, _ in held:
                if any(len(np.unique(w[np.isin(w, s)])) >= 0.8 * len(s) for a in range(0, len(shingles), span) for w in [shingles[a : a + 2 * span]]):
                    want.add(other)
        assert {m[0] for m in scanner.scan(text)} == want


def test_scan_over_a_table(spark):
    notice = "// Released under the MIT License. \n"
    texts = [None, "", "few words", "intro " * 9000 + notice, notice, notice, "permission is not granted to any person at all today"]
    got = {r["doc_id"]: r for r in license_scan.scan(docs(spark, texts), TEMPLATES).collect()}
    assert [got[i]["n_matches"] for i in range(7)] == [0, 0, 0, 1, 1, 1, 0]
    assert got[4]["licenses"] == "MIT" and got[4]["matches"][0]["first_word"] == 1 and got[3]["matches"][0]["first_word"] == 9001
    with pytest.raises(ValueError):
        license_scan.Scanner({"x": "too short"}, 0.8, 44)


def test_scan_finds_notices_of_fewer_words_than_a_shingle(spark):
    from mzframe.llm.license_templates import SHORT_TEMPLATES

    texts = ["All rights reserved.", "x " * 9000 + "(c) All rights - reserved! and on", "# SPDX-License-Identifier: MIT", "the MIT License", "all rights are reserved", "all rights", "Released under the MIT License"]
    got = {r["doc_id"]: [tuple(m)[:3] for m in r["matches"]] for r in license_scan.scan(docs(spark, texts), TEMPLATES | SHORT_TEMPLATES).collect()}
    line = "reserved:line"
    want = [[(line, 0, 3)], [(line, 9001, 9005)], [("MIT:identifier", 1, 3)], [("MIT:name", 1, 3)], [], [], [("MIT:notice", 0, 5), ("MIT:name", 3, 5)]]
    assert [got[i] for i in range(7)] == want
    with pytest.raises(ValueError):
        license_scan.Scanners({"x": "--"}, 0.8, 44)


# quality


def test_em_recovers_the_accuracies_of_labellers():
    rng = np.random.default_rng(5)
    good = rng.random(20000) < 0.7
    right = [0.95, 0.8, 0.9, 0.7, 0.85]
    votes = np.stack([np.where(rng.random(20000) < p, good, ~good) * 2 - 1 for p in right], axis=1)
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    model = weak_labels.fit_labels([(tuple(p), int(c)) for p, c in zip(patterns.tolist(), n, strict=True)], 5)
    assert np.abs(model.accuracy() - right).max() < 0.05 and abs(model.prior - 0.7) < 0.05
    assert ((model.posterior(votes) > 0.5) == good).mean() > 0.93


def test_classifier_on_held_out_labels(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no tables")
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = weak_labels.classify(df, weak_labels.fit(df)).join(labels, "doc_id").toPandas()
    assert (got["kept"] == (got["quality"] == 1)).mean() > 0.95
    assert got[got["quality"] == 1]["kept"].mean() > 0.99


def test_classifier_on_odd_tables(spark):
    texts = [None, "", "The end of the day was in the rain and it is for the best of all of us to see that.", "### @@@ %%% $$$ *** &&&", "The " * 30000]
    df = docs(spark, texts)
    scorer = weak_labels.fit(df)
    got = weak_labels.classify(df, scorer)
    assert got.count() == 5 and sorted(weak_labels.accepted(df, scorer).columns) == sorted(df.columns)
    empty = df.limit(0)
    assert weak_labels.classify(empty, weak_labels.fit(empty)).count() == 0


# near-duplicates


def test_draws_collide_as_often_as_the_weighted_jaccard_says():
    rng = np.random.default_rng(4)
    s = np.sort(rng.integers(0, 2**63, 400, dtype="uint64"))
    u, v = rng.uniform(0.5, 3, 400), rng.uniform(0.5, 3, 400)
    want = np.minimum(u, v).sum() / np.maximum(u, v).sum()
    same = (near_dedup.sample(s, u, 3000) == near_dedup.sample(s, v, 3000)).mean()
    assert abs(same - want) < 0.04
    assert abs(near_dedup.similarity((s, u), (s, v)) - want) < 1e-9


def variants(random_, words, n, rate):
    return [" ".join(f"n{random_.randrange(9999)}" if random_.random() < rate else w for w in words) for _ in range(n)]


def test_groups_equal_brute_force(spark):
    random_ = random.Random(6)
    texts = [None, "", "  ", "one two", "one two", "One  TWO", "Solo text of its own that nobody copies at all"]
    for g in range(4):
        words = [f"g{g}w{random_.randrange(400)}" for _ in range(120)]
        texts += variants(random_, words, 12, 0.012)
        texts += variants(random_, words, 3, 0.3)
    df = docs(spark, texts)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, star_block=4, block=5).collect()}
    weigh = near_dedup.Weigher(near_dedup.idf_weights(near_dedup.count_sketch(df)))
    shapes, union = [weigh.of_text(t) for t in texts], near_dedup.Union()
    for i in range(len(texts)):
        for j in range(i):
            if near_dedup.similarity(shapes[i], shapes[j]) >= 0.8:
                union.link(i, j)
    want = {i: union.root(i) for i in range(len(texts))}
    assert got == want
    kept = near_dedup.deduplicated(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def plain_near_duplicates(rows, counts):
    """{id: smallest id of its group} by exact weighted Jaccard over all pairs with a common shingle, without the operator's
    sampling, weights or similarity; counts: of documents by bucket of a shingle's hash."""
    hashed = near_dedup.Shingler()
    held = max(sum(counts), 1)
    share = [max(c, 1) / held for c in counts]
    weight = [0.75 + 0.25 * min(1.0, max(0.0, -math.log(x) / math.log(len(counts)))) for x in share]
    docs_, holders, up = [], {}, {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    def link(i, j):
        i, j = sorted((root(i), root(j)))
        up[j] = i

    for k, (i, t) in enumerate(rows):
        words = (t or "").lower().split()
        grams = Counter(" ".join(words[a : a + 5]) for a in range(max(1, len(words) - 4))) if words else Counter()
        bag = {g: n * weight[int(hashed.shingles(g.split())[0][0]) * len(counts) >> 64] for g, n in grams.items()}
        near = Counter()
        for g, w in bag.items():
            for j, v in holders.get(g, ()):
                near[j] += min(w, v)
        total = sum(bag.values())
        for j, common in near.items():
            if common >= 0.8 * (total + docs_[j][1] - common) - 1e-9:
                link(i, docs_[j][0])
        if not bag:
            for j, n in docs_:
                if n == 0:
                    link(i, j)
        for g, w in bag.items():
            holders.setdefault(g, []).append((k, w))
        docs_.append((i, total))
    return {i: root(i) for i, _ in rows}


def test_a_whole_table_of_documents_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = plain_near_duplicates(rows, near_dedup.count_sketch(df).tolist())
    got = {r["doc_id"]: r["component_id"] for r in queries.op9_weighted_minhash(spark, "/root/testdata/sf0.01").collect()}
    copies = [i for i in want if sum(v == want[i] for v in want.values()) > 1]
    assert len(copies) > 100 and got == want


def test_rows_of_one_id_are_one_document(spark):
    long = ["a b c d e f g h i j k l m n", "o p q r s t u v w x y z 1 2", "3 4 5 6 7 8 9 0 a1 b1 c1 d1 e1"]
    big = (1 << 53) + 1
    df = docs(spark, [long[0], long[1], long[1], long[2], long[0], long[2] + " f1 " * 40], ids=[big, big, big + 1, big + 2, None, None])
    got = near_dedup.near_duplicates(df).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(big, big), (big + 1, big), (big + 2, big + 2), (None, None)} and len(got) == 6
    kept = near_dedup.deduplicated(df).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(0, long[0]), (0, long[2] + " f1 " * 40), (big, long[0]), (big + 2, long[2])])


def test_near_duplicates_of_odd_tables(spark):
    df = docs(spark, ["a b c d e f g", "a b c d e f g", "x y z q r s t"], ids=[5, 5, None])
    got = near_dedup.near_duplicates(df).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True), (5, 5, True), (5, 5, True)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_rows_without_partners_of_like_size_leave_their_bucket(spark):
    rows = [(0, 1, 1, 100.0), (0, 1, 2, 81.0), (0, 1, 3, 300.0), (0, 1, 4, 30.0), (0, 1, 5, 30.0), (0, 2, 6, 0.0), (0, 2, 7, 9.0), (0, 3, 8, 5.0)]
    df = spark.createDataFrame(rows, "band int, bucket long, rep long, total double").withColumn("size", near_dedup._size(near_dedup.F.col("total"), 0.8))
    assert sorted(r["rep"] for r in near_dedup.with_partners(df, "rep").collect()) == [1, 2, 4, 5]
    joined = df.withColumn("comp", near_dedup.F.when(df.rep.isin(4, 5), 4).otherwise(df.rep))
    assert sorted(r["rep"] for r in near_dedup.with_partners(joined, "comp").collect()) == [1, 2]
    totals = [round(1.05**k, 6) for k in range(-20, 90)]
    df = spark.createDataFrame([(t,) for t in totals], "total double")
    sizes = [r[0] for r in df.select(near_dedup._size(df.total, 0.8)).collect()]
    assert all(abs(a - b) <= 1 for t, a in zip(totals, sizes, strict=True) for u, b in zip(totals, sizes, strict=True) if min(t, u) >= 0.8 * max(t, u))
