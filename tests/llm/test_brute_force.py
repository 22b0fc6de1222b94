"""Queries that SQL cannot express, against plain versions that share nothing with them but fixed lists and hashes."""

import math
import random
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np

from mzframe.llm import license_scan, queries, url_filter, weak_labels
from mzframe.llm.license_templates import TEMPLATES

DATA = "/root/testdata/sf0.001"


# license scans


def plain_shingles(text):
    words = [w for w in (x.strip(license_scan.PUNCTUATION) for x in text.lower().split()) if w]
    return [" ".join(words[k : k + 5]) for k in range(len(words) - 4)]


def test_scan_misses_no_alignment():
    """Whatever run of a text holds 0.8 of a template is found wherever it begins, and nothing is found without one."""
    scanner, random_ = license_scan.Scanners(TEMPLATES, 0.8, 44), random.Random(8)
    distinct = {n: set(plain_shingles(t)) for n, t in TEMPLATES.items()}
    span = {n: 1 << max(2, math.ceil(math.log2(1.25 * len(s)))) for n, s in distinct.items()}
    noise = [f"w{k}" for k in range(500)]
    for lead in [*range(0, 70, 3), *range(8_100, 8_300, 37)]:
        name = random_.choice(sorted(TEMPLATES))
        words = TEMPLATES[name].split()
        for k in range(random_.randint(0, max(0, len(words) // 30))):
            words[random_.randrange(len(words))] = f"z{k}"
        text = " ".join(random_.choices(noise, k=lead) + words + random_.choices(noise, k=random_.randint(0, 90)))
        shingles = plain_shingles(text)
        share = lambda n, size: max((len(set(shingles[a : a + size]) & distinct[n]) for a in range(max(1, len(shingles)))), default=0) / len(distinct[n])
        near = [n for n in distinct if len(set(shingles) & distinct[n]) >= 0.8 * len(distinct[n])]
        must = {n for n in near if share(n, math.ceil(1.25 * len(distinct[n]))) >= 0.8}
        may = {n for n in near if share(n, 2 * span[n]) >= 0.8}
        assert must <= {m[0] for m in scanner.scan(text)} <= may and name in may | {name}


def test_a_table_of_bands_gives_what_comparing_all_gives():
    rng = np.random.default_rng(9)
    signatures = [rng.integers(0, 50, (6, 1), dtype="uint64") + (np.arange(6, dtype="uint64") << np.uint64(32))[:, None] for _ in range(40)]
    minima = rng.integers(0, 50, (6, 200), dtype="uint64") + (np.arange(6, dtype="uint64") << np.uint64(32))[:, None]
    want = sorted((w, k) for k, s in enumerate(signatures) for w in np.flatnonzero((minima == s).any(0)))
    assert license_scan.BandTable(signatures).lookup(minima) == want


# quality


def plain_votes(text):
    words, lines = text.split(), text.split("\n")
    n, size = max(1, len(words)), max(1, len(text))
    share = lambda pattern, of: len(re.findall(pattern, text)) / of
    stops = sum(w.lower() in weak_labels.STOP_WORDS for w in words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    most = max(Counter(words).values(), default=0)
    vote = lambda bad, good: -1 if bad else 1 if good else 0
    return (
        vote(share(r"[#$%&*@^~_]", size) > 0.1, share(r"[#$%&*@^~_]", size) < 0.03), vote(share(r"[|{}<>=]", n) > 0.15, share(r"[|{}<>=]", n) < 0.02),
        vote(share("[A-Z]", size) > 0.3, share("[A-Z]", size) < 0.1), vote(share("[!?]", n) > 0.3, share("[!?]", n) < 0.1),
        vote(len(words) >= 20 and stops < 0.03 * n, stops > 0.08 * n), vote(len(words) >= 100 and len(set(words)) < 0.25 * n, len(words) >= 30 and len(set(words)) > 0.35 * n),
        vote(len(lines) >= 4 and len(set(lines)) / len(lines) < 0.6, len(set(lines)) / len(lines) > 0.8), vote(len(words) >= 40 and share("[.!?]", n) < 0.005, share("[.]", n) > 0.02),
        vote(size / n > 14 or size / n < 3, 4 <= size / n <= 10), vote(share("[0-9]", size) > 0.25, share("[0-9]", size) < 0.05), vote(n < 5, n >= 20),
        vote(n >= 10 and same > 0.15 * n, same < 0.03 * n), vote(n >= 20 and most > 0.25 * n, n >= 20 and most < 0.2 * n),
    )


def plain_posteriors(votes, rounds=200):
    """EM, document by document."""
    n, m = len(votes), len(votes[0])
    good = [0.1 if -1 in v else 0.95 for v in votes]
    for _ in range(rounds):
        chance = [[{v: (0.1 if v else 0.01) * n / 1000 + 1e-3 for v in (-1, 0, 1)} for _ in range(m)] for _ in (0, 1)]
        for row, g in zip(votes, good, strict=True):
            for j, v in enumerate(row):
                chance[0][j][v] += 1 - g
                chance[1][j][v] += g
        prior = min(max(sum(good) / n, 0.01), 0.99)
        ratio = []
        for j in range(m):
            p = [{v: chance[y][j][v] / sum(chance[y][j].values()) for v in (-1, 0, 1)} for y in (0, 1)]
            ratio.append({-1: min(0.0, math.log(p[1][-1] / p[0][-1])), 0: 0.0, 1: max(0.0, math.log(p[1][1] / p[0][1]))})
        new = [1 / (1 + math.exp(-min(50, max(-50, sum(ratio[j][v] for j, v in enumerate(row)) + math.log(prior / (1 - prior)))))) for row in votes]
        still = max(abs(a - b) for a, b in zip(new, good, strict=True)) < 1e-9
        good = new
        if still:
            break
    return good


def plain_scores(texts, target, size=1 << 14):
    """Logistic regression over a full matrix of hashed words, shapes and echoes."""
    x = np.zeros((len(texts), size))
    for row, text in zip(x, texts, strict=True):
        words = text.split()
        words += ["\n"] * sum(a == b for a, b in zip(words, words[1:], strict=False))
        for w in words:
            shape = re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in w))[:12]
            row[zlib.crc32(w.lower().encode()) % size] += 1
            row[zlib.crc32(b"shape:" + shape.encode()) % size] += 1
        row /= max(1, len(words))
    x = np.sqrt(x)
    w, b, seen = np.zeros(size), 0.0, np.full(size, 1e-8)
    for _ in range(150):
        off = (1 / (1 + np.exp(-(x @ w + b))) - target) / len(texts)
        g = x.T @ off + 1e-5 * w
        seen += g * g
        w -= 2.0 * g / np.sqrt(seen) * 0.1
        b -= 2.0 * off.sum()
    return 1 / (1 + np.exp(-(x @ w + b)))


def test_quality_of_a_whole_table_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in queries.op4_weak_labels(spark, DATA).collect()}
    assert sorted(got) == sorted(texts) and len(texts) >= 200
    votes = [plain_votes(t) for t in texts.values()]
    assert [tuple(got[i]["votes"]) for i in texts] == votes
    posteriors = plain_posteriors(votes)
    assert max(abs(got[i]["posterior"] - p) for i, p in zip(texts, posteriors, strict=True)) < 1e-6
    scores = plain_scores(list(texts.values()), np.array(posteriors))
    assert max(abs(got[i]["score"] - p) for i, p in zip(texts, scores, strict=True)) < 1e-4
    assert all(got[i]["kept"] == (p >= 0.5) for i, p in zip(texts, scores, strict=True) if abs(p - 0.5) > 1e-3)


# url filters


def test_verdicts_of_a_whole_table_equal_brute_force(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").collect()
    counts = Counter(w for p in pages for w in re.split(r"[^a-z]+", re.sub(r"<[^>]*>", " ", p["html"] or "").lower()) if 2 <= len(w) <= 24)
    top = max(counts.values()) // 1000 + 1
    for w in url_filter.SEED_WORDS:
        counts[w] = max(counts[w], top)
    total = sum(counts.values()) + 1

    @cache
    def split(name):
        """Every split of the name, by its cost; of equal ones that with the longest last word."""
        if not name:
            return 0.0, ()
        found = []
        for k in range(1, min(24, len(name)) + 1):
            word = name[-k:]
            if k > 1 and word in counts or k == 1:
                cost, words = split(name[:-k])
                found.append((cost + (math.log(total / counts[word]) if k > 1 else math.log(total) + 10), len(name) - k, (*words, word)))
        cost, _, words = min(found)
        return cost, words

    def tokens(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        out = []
        for label in re.split("[^a-z0-9]+", host):
            if label and label not in url_filter.PLAIN_LABELS:
                for part in re.findall("[a-z]+|[0-9]+", label):
                    out += [f"h:{w}" for w in split(part)[1]] if part[0].isalpha() else ["h:<n>"]
        return out + ["p:<n>" if p[0].isdigit() else f"p:{p}" for p in re.findall(r"[^\W\d_]+|\d+", path.lower())]

    rows = {p["page_id"]: tokens(p["url"]) for p in pages}
    bad = {i: bool({t[2:] for t in ts} & url_filter.STRONG_WORDS) or len({t[2:] for t in ts} & set(url_filter.SEED_WORDS)) > 1 for i, ts in rows.items()}
    held = [Counter(t for i, ts in rows.items() if bad[i] == side for t in ts) for side in (False, True)]
    kinds = len(set(held[0]) | set(held[1]))
    sums = [sum(h.values()) + kinds + 1 for h in held]
    prior = math.log((sum(bad.values()) + 1) / (len(bad) - sum(bad.values()) + 1))
    got = {r["page_id"]: r for r in queries.op6_url_filter(spark, DATA).collect()}
    assert sorted(got) == sorted(rows)
    for i, ts in rows.items():
        score = prior + sum(math.log((held[1][t] + 1) / sums[1]) - math.log((held[0][t] + 1) / sums[0]) for t in ts)
        assert abs(got[i]["score"] - score) < 1e-6 and got[i]["words"] == " ".join(t[2:] for t in ts if t.startswith("h:"))
        if got[i]["rule"] is None:
            assert got[i]["verdict"] == ("block" if score > 0 else "allow")
