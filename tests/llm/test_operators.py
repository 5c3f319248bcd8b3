"""Every operator beside a plain computation, on odd texts and on the smallest tables."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import ODD, WORD, lower
from veilframe.llm import (
    decontamination,
    language_model,
    license_scan,
    line_dedup,
    packing,
    quality_classifier,
    quality_rules,
    simhash,
    suffix_dedup,
    token_counts,
)

SF_DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def union_find(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# 1


def plain_measures(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_ledger(make):
    texts = [*ODD, "### a | b", "a b c d e f a b c d e f g", "HEY YOU ALL " * 5]
    rows = quality_rules.ledger(make(texts, extra=True)).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows}
    assert got == {i: plain_measures(t) for i, t in enumerate(texts)}


def test_policy_keeps_whole_rows(make):
    good = " ".join(f"word{i}" for i in range(40))
    docs = make([(1, good), (1, good), (None, good), (2, "short"), (3, None)], extra=True)
    kept = quality_rules.apply_policy(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"]
    assert quality_rules.apply_policy(docs.limit(0)).collect() == []


def test_ablation_counts(make):
    docs = make(["few", "### " * 20, " ".join(f"w{i}" for i in range(30))])
    rows = {(r.policy, r.rule): r for r in quality_rules.ablation(quality_rules.ledger(docs)).collect()}
    base = rows["base", "few_words"]
    assert (base.failing, base.kept, base.kept_without_rule) == (1, 1, 2)


# 2


@tables
def test_classifier_agrees_with_labels(spark, documents):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    train = labels.where("doc_id % 2 = 0")
    kept = {r.doc_id: r.kept for r in quality_classifier.classify(documents, train).collect()}
    held = [(r.quality, kept[r.doc_id]) for r in labels.where("doc_id % 2 = 1").collect()]
    assert sum(bool(q) == k for q, k in held) / len(held) > 0.85


def test_classifier_on_odd_input(spark, make):
    docs = make(ODD).selectExpr("*", "CAST(NULL AS STRING) AS source", "'en' AS lang")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = quality_classifier.classify(docs, none).collect()
    assert len(rows) == len(ODD) and len({round(r.document_odds, 9) for r in rows}) == 1
    labels = spark.createDataFrame([(0, 0), (5, 1), (5, None), (99, 1)], "doc_id bigint, quality int")
    assert len(quality_classifier.classify(docs.unionAll(docs), labels).collect()) == 2 * len(ODD)
    assert quality_classifier.classify(docs.limit(0), labels).collect() == []


def test_sparse_sites_shrink_toward_all(spark, make):
    good, bad = " ".join(f"word{i}" for i in range(60)), "### $$$ " * 30
    rows = [(i, good, "big") for i in range(40)] + [(100, good, "small"), (101, bad, "junk")]
    rows += [(200 + i, bad, "junk") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "'en' AS lang")
    labels = docs.selectExpr("doc_id", "CAST(source != 'junk' AS INT) AS quality")
    found = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    assert found[101].path_posterior < found[100].path_posterior < found[0].path_posterior


# 3


def test_posteriors_against_plain_sums(spark, make):
    """Sites' posteriors from labels and the classifier's own guesses, group by group."""
    rng = random.Random(2)
    rows = []
    for i in range(60):
        host, path = rng.choice(["a", "b", None]), rng.choice(["x", "y"])
        good = rng.random() < (0.9 if host == "a" else 0.3)
        rows.append((i, " ".join("word" if good else "###" for _ in range(rng.randint(3, 40))), host, path, "clash"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, odds string")
    told = {i: int("word" in t) for i, t, *_ in rows if i % 3 == 0}
    labels = spark.createDataFrame([*told.items(), (5, None), (900, 1)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    value = {i: float(told.get(i, 1 / (1 + math.exp(-found[i].document_odds)))) for i in found}
    mean = sum(value.values()) / len(value)

    def strength(key):
        groups = collections.defaultdict(list)
        for i, _, *site in rows:
            groups[key(site)].append(value[i])
        n, k = len(rows), len(groups)
        within = sum((v - np.mean(g)) ** 2 for g in groups.values() for v in g) / (n - k)
        between = sum(len(g) * (np.mean(g) - mean) ** 2 for g in groups.values())
        variance = (between - (k - 1) * within) / (n - sum(len(g) ** 2 for g in groups.values()) / n)
        return groups, min(max(within / max(variance, 1e-6), 1.0), 1e4)

    hosts, host_prior = strength(lambda site: site[0])
    paths, path_prior = strength(lambda site: tuple(site[:2]))
    for i, _, host, path, _ in rows:
        of_host = (sum(hosts[host]) - value[i] + host_prior * mean) / (len(hosts[host]) - 1 + host_prior)
        group = paths[host, path]
        of_path = (sum(group) - value[i] + path_prior * of_host) / (len(group) - 1 + path_prior)
        assert abs(found[i].host_posterior - of_host) < 1e-9
        assert abs(found[i].path_posterior - of_path) < 1e-9
        odds = found[i].document_odds + math.log(of_path / (1 - of_path)) - math.log(mean / (1 - mean))
        assert abs(found[i].posterior - 1 / (1 + math.exp(-odds))) < 1e-9


def test_classifier_sample_is_bounded(spark, make, monkeypatch):
    docs = make([f"word {'#' * (i % 7)} " * (i % 11 + 1) for i in range(200)])
    docs = docs.selectExpr("*", "'a' AS source", "'x' AS lang")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 7 < 3 AS INT) AS quality")
    monkeypatch.setattr(quality_classifier, "MOST_LABELLED", 50)
    assert len({r.posterior for r in quality_classifier.classify(docs, labels).collect()}) > 1


def best_by_enumeration(text, pieces, unknown):
    """All segmentations of a word, by score; the counts of the best ones."""
    best = {0: [(0.0, 0)]}
    for end in range(1, len(text) + 1):
        found = [(s + pieces[text[a:end]], n + 1) for a in range(end) if text[a:end] in pieces for s, n in best[a]]
        if text[end - 1] not in pieces:
            size = len(text[end - 1].encode())
            found += [(s + unknown, n + size) for s, n in best[end - 1]]
        best[end] = found
    top = max(s for s, _ in best[len(text)])
    return top, {n for s, n in best[len(text)] if s == top}


def test_viterbi_against_enumeration():
    rng = random.Random(5)
    for _ in range(200):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 3))): -float(rng.randint(1, 6)) for _ in range(6)}
        counter = token_counts.UnigramCounter(tuple(pieces.items()))
        text = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 8)))
        count, score = counter.word(text)
        top, counts = best_by_enumeration(text, pieces, min(pieces.values()) - token_counts.UNKNOWN_PENALTY)
        assert score == top and count in counts


@tables
def test_counts_equal_the_tokenizer(documents, make):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.vocabulary()
    least = min(s for _, s in pieces)
    table = [("<unk>", least), *pieces, *[(f"<0x{b:02X}>", least) for b in range(256)]]
    tokenizer = Tokenizer(models.Unigram(table, unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    for docs in (documents, make([*ODD, "  two  spaces", "▁mark ▁", "\n\n"])):
        got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()}
        for row in docs.collect():
            expected = len(tokenizer.encode(row.text, add_special_tokens=False).ids) if row.text else 0
            assert got[row.doc_id] == expected, row.doc_id


# 4


def check_packing(docs, rows, size=2048):
    from tokenizers import Tokenizer

    from veilframe.llm.tokenizing import tokenizer_path

    tokenizer = Tokenizer.from_file(tokenizer_path(packing.TOKENIZER))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc in docs:
        ids = np.array([*tokenizer.encode(doc.text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[doc.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size and (at == size or at & (at - 1) == 0)


@tables
def test_packing(documents):
    check_packing(documents.collect(), packing.pack(documents).collect())


def test_packing_odd_texts(make):
    texts = [*ODD, "x<|endoftext|>y", " lead", "trail \n ", "it's  'they've'\t12 34", "\x85   a"]
    docs = make(texts, extra=True)
    check_packing(docs.collect(), packing.pack(docs, group_tokens=50).collect())
    assert packing.pack(docs.limit(0)).collect() == []


def test_assignment_balances_cost():
    rng = random.Random(2)
    lengths = [rng.randint(1, 400) for _ in range(300)]
    placed = packing.assign(lengths, 1024)
    costs = collections.Counter()
    for _, _, length, sequence, _ in placed:
        costs[sequence] += packing.piece_cost(length)
    full = [costs[s] for s in costs if sum(p[2] for p in placed if p[3] == s) == 1024]
    assert max(full) < 1.2 * min(full)


def test_assignment_looks_at_every_sequence():
    rng = random.Random(8)
    for size, n in ((1024, 400), (2048, 900), (64, 500)):
        lengths = [rng.choice([rng.randint(1, size // 20), rng.randint(1, size - 1)]) for _ in range(n)]
        room = packing.capacities(sum(lengths), size)
        cost, expected = [0.0] * len(room), []
        for doc in sorted(range(n), key=lambda d: (-lengths[d], d)):
            left, start = lengths[doc], 0
            while left:
                fitting = [s for s in range(len(room)) if room[s] >= left] if not start else []
                s = min(fitting or [s for s in range(len(room)) if room[s]], key=lambda s: (cost[s], s))
                length = min(left, room[s])
                expected.append((doc, start, length, s))
                room[s] -= length
                cost[s] += packing.piece_cost(length)
                start, left = start + length, left - length
        assert len(cost) > 64
        assert [p[:4] for p in packing.assign(lengths, size)] == expected


# 5


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination_against_plain_distance(spark, make):
    rng = random.Random(1)
    items = [(i, "".join(rng.choice("abc de") for _ in range(rng.choice([45, 64, 65, 130])))) for i in range(4)]
    texts = [None, "", "abc"]
    for _ in range(30):
        part = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 12)):
            part[rng.randrange(len(part))] = rng.choice(["", "x", "a", "bb"])
        texts.append("".join(rng.choice("abc de") for _ in range(30)) + "".join(part) + " tail")
    table = spark.createDataFrame([*items, (9, None), (10, "short"), items[0]], "item_id bigint, text string")
    docs = make(texts, extra=True)
    expected = {}
    for i, text in enumerate(texts):
        for item, wanted in items:
            wanted = decontamination.normalised(wanted)
            edits = least_edits(wanted, decontamination.normalised(text))
            if edits <= int(0.1 * len(wanted)):
                expected[i, item] = edits
    for block in (decontamination.BLOCK_CHARS, 100):
        rows = decontamination.contaminated(docs, table, block_chars=block).collect()
        assert {(r.doc_id, r.item_id): r.distance for r in rows} == expected
        clean = decontamination.drop_contaminated(docs, table, block_chars=block)
        assert clean.columns == docs.columns
        assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {i for i, _ in expected}
    assert decontamination.contaminated(docs, table.limit(0)).collect() == []
    assert decontamination.drop_contaminated(docs, table.limit(0)).count() == docs.count()
    assert decontamination.contaminated(docs.limit(0), table, block_chars=100).collect() == []


def test_decontamination_of_rows_that_share_an_id(spark, make):
    item = "an item of the benchmark, long enough for some edits"
    table = spark.createDataFrame([(1, item), (None, "another item without any id of its own")], "item_id bigint, text string")
    docs = make([(1, f"x {item} y"), (1, "clean"), (1, f"x {item} y"), (None, "clean too"), (None, f"{item}!")])
    for block in (decontamination.BLOCK_CHARS, 100):
        rows = decontamination.contaminated(docs, table, block_chars=block).collect()
        assert sorted((str(r.doc_id), r.item_id) for r in rows) == [("1", 1), ("1", 1), ("None", 1)]
        clean = decontamination.drop_contaminated(docs, table, block_chars=block)
        assert sorted(r.text for r in clean.collect()) == ["clean", "clean too"]


def test_masks_hold_an_items_own_symbols():
    rng = random.Random(5)
    items = [(i, "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(100))) for i in range(500)]
    matcher = decontamination.Matcher(items)
    assert sum(masks.nbytes for _, masks in matcher._masks) < 1 << 20
    spoilt = items[7][1][:50] + "x" + items[7][1][51:]
    assert [hit[:3] for hit in matcher.find([f"before {items[3][1]} behind", spoilt])] == [(0, 3, 0), (1, 7, 1)]


def test_short_items_are_found(spark, make):
    items = [(1, "What is the capital of France?"), (2, "Who wrote it"), (3, "2+2=4"), (4, " \n"), (5, "ion"), (6, "é")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    texts = [
        "so: what  is the\ncapital of FRANCE? paris",
        "what is teh capital of france?",
        "what was the capitol in france?",
        "who wrode it",
        "who wrodde it",
        "(2+2=4)",
        "12+2=4",
        "nation ions",
        "an ion.",
        "été é",
        "été",
    ]
    expected = {(0, 1, 0), (1, 1, 2), (3, 2, 1), (5, 3, 0), (8, 5, 0), (9, 6, 0)}
    rows = decontamination.contaminated(make(texts), table).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in rows} == expected
    clean = decontamination.drop_contaminated(make(texts), table).collect()
    assert {r.doc_id for r in clean} == set(range(len(texts))) - {d for d, _, _ in expected}


# 6


def check_repeats(texts, rows, length):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    expected = collections.Counter()
    for raw in raws:
        covered = np.zeros(len(raw) + 1, np.int64)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                covered[i] += 1
                covered[i + length] -= 1
        gone = np.cumsum(covered)[:-1] > 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        expected[len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert collections.Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == expected


@pytest.mark.parametrize("most", [2, 1000])
def test_repeats_on_odd_texts(make, most):
    rng = random.Random(4)
    parts = ["".join(rng.choice("abé ") for _ in range(60)) for _ in range(6)]
    texts = [*ODD, *["".join(rng.choice(parts)[rng.randint(0, 20) :] for _ in range(4)) for _ in range(30)], "a" * 500]
    rows = [*enumerate(texts), (7, texts[7]), (None, texts[10]), (None, texts[11])]
    docs = make(rows, extra=True)
    found = suffix_dedup.remove_repeats(docs, length=40, anchor=16, shard_bytes=2000, most_segments=most).collect()
    check_repeats([t for _, t in rows], found, 40)
    for row in found:
        assert sum(s.end - s.begin for s in row.removed) == row.n_removed


@tables
def test_repeats(documents):
    rows = suffix_dedup.remove_repeats(documents, with_text=False).collect()
    check_repeats([d.text for d in documents.collect()], rows, 200)


# 7


def licence_words(text):
    """Words without the punctuation around them."""
    found = (w.strip(license_scan.PUNCTUATION) for w in WORD.findall(text.lower()))
    return [w for w in found if w]


def plain_share(notice, text):
    def shingles(words):
        return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}

    wanted = shingles(licence_words(notice))
    return len(wanted & shingles(licence_words(text))) / len(wanted)


def plain_licences(texts):
    """By the best stretch of any place and of at most four times the notice's words."""
    found = {}
    for i, text in enumerate(texts):
        words = licence_words(text or "")
        for n, (_, notice) in enumerate(license_scan.NOTICES):
            size = len(licence_words(notice))
            shares = [plain_share(notice, " ".join(words[a : a + 2 * size])) for a in range(len(words))]
            if shares and max(shares) >= 0.8:
                found[i, n] = max(shares)
    return found


def test_licences(spark, make):
    notices = license_scan.NOTICES
    text = notices[5][1]
    words = text.split()
    words[3] = "changed"
    filler = " ".join(f"w{i}" for i in range(70))
    texts = [
        *ODD[:8],
        f"{filler} {text} {filler}",
        f"{filler}\n{' '.join(words)}",
        text.upper(),
        " ".join(words[:12]),
        "w " * 300 + text,
        "- " * 300 + "-" * 5000 + " x",
        # Punctuation on either side is not part of a word.
        "Released under the MIT License",
        "(Licensed under CC BY-NC 4.0)",
        "Licensed under the Apache License, Version 2.0",
        "* \u201cReleased under - the MIT License\u201d, see there",
        *[f"{filler}\n{n}\n{filler}" for _, n in notices],
    ]
    docs = make(texts, extra=True)
    expected = plain_licences(texts)
    assert {d for d, _ in expected} >= {8, 9, 10, 14, 15, 16, 17, *range(18, 18 + len(notices))} and (11, 5) not in expected
    found = {(r.doc_id, r.notice) for r in license_scan.scan(docs).collect()}
    assert found == set(expected)
    # As a table, and as one too large to travel with the tasks.
    table = spark.createDataFrame([(i, *n) for i, n in enumerate(notices)], "notice int, license string, text string")
    for most in (license_scan.MOST_SHINGLES, 10):
        found = {(r.doc_id, r.notice) for r in license_scan.scan(docs, table, most_shingles=most).collect()}
        assert found == set(expected)


def test_licences_of_odd_tables(make):
    text = license_scan.NOTICES[1][1]
    texts = [*ODD, text]
    assert license_scan.scan(make(texts).limit(0)).collect() == []
    assert license_scan.scan(make(texts), texts=[("none", "too short")]).collect() == []
    rows = license_scan.scan(make([(None, text), (None, f"other {text}"), (1, text), (1, text), (1, f"{text} x"), (2, None)]))
    assert sorted(str(r.doc_id) for r in rows.collect()) == ["1", "1", "None", "None"]


@tables
def test_licences_equal_plain_containment(documents):
    found = {(r.doc_id, r.notice) for r in license_scan.scan(documents).collect()}
    texts = {d.doc_id: d.text for d in documents.collect()}
    expected = {
        (doc, i)
        for doc, text in texts.items()
        for i, (_, notice) in enumerate(license_scan.NOTICES)
        if any(plain_share(notice, part) >= 0.8 for part in text.split("\n"))
    }
    assert expected <= found
    # What no line holds stands across lines.
    for doc, i in found - expected:
        notice, words = license_scan.NOTICES[i][1], licence_words(texts[doc])
        size = 4 * len(licence_words(notice))
        assert any(plain_share(notice, " ".join(words[a : a + size])) >= 0.8 for a in range(len(words)))


# 8


def plain_walk(rows, held, order):
    """(tokens, known, base, score) of each row: the automaton state by state, in dicts."""
    words = [["\n", *WORD.findall(lower(t or "")), "\n"] for _, t in rows]
    arcs = collections.defaultdict(collections.Counter)
    for out, w in zip(held, words):
        for i in range(1, 0 if out else len(w)):
            for n in range(order):
                if n <= i:
                    arcs[tuple(w[i - n : i])][w[i]] += 1
    single = arcs[()]
    total, share = sum(single.values()), language_model.SHARE

    def weight(state, x):
        if not state:
            return (single[x] + 0.5) / (total + 0.5 * (len(single) + 1))
        if state not in arcs:
            return weight(state[1:], x)
        return share * arcs[state][x] / sum(arcs[state].values()) + (1 - share) * weight(state[1:], x)

    found = []
    for w in words:
        base = sum(math.log10(weight((), x)) for x in w[1:])
        score = sum(math.log10(weight(tuple(w[max(0, i - order + 1) : i]), w[i])) for i in range(1, len(w)))
        found.append((len(w) - 1, sum(single[x] > 0 for x in w[1:]), total, round(base, 6), round(score, 6)))
    return found


@pytest.mark.parametrize("order, size", [(1, 400), (2, 400), (3, 400), (3, 1 << 20), (5, 400)])
def test_language_model(make, order, size):
    texts = [*ODD, *["a b c a b", "B c a x", "new words here", "a b c x", "b c a b c a b"] * 4]
    rows = [*enumerate(texts), (None, "a b"), (None, "b c a"), (3, "one"), (3, "a b"), (3, "one")]
    docs = make(rows, extra=True)
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    assert any(held)
    expected = [(str(i), out, *rest) for (i, _), out, rest in zip(rows, held, plain_walk(rows, held, order))]
    got = [
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
        for r in language_model.score(docs, order=order, block_bytes=size, bucket_bytes=size).collect()
    ]
    assert sorted(got) == sorted(expected)
    assert language_model.score(docs.limit(0), order=order).collect() == []


@tables
def test_model_beats_its_base_on_held_out_texts(documents):
    rows = [r for r in language_model.score(documents).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    longer = [r.score for r in language_model.score(documents, order=3).collect() if r.held_out]
    assert sum(longer) > sum(r.score for r in rows)


# 9


def plain_fingerprint(text, words=3):
    found = WORD.findall(lower(text or ""))
    runs = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)] * bool(found)
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("posting", [2, 8192])
def test_simhash(make, posting):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 50)}" for _ in range(120)]
    texts = list(ODD)
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(120)] = f"v{rng.randint(0, 9)}"
        texts.append(" ".join(copy))
    rows = [*[(i + 10, t) for i, t in enumerate(texts)], (None, "one"), (10, None)]
    prints = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for j in range(len(rows)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 3]
    roots = union_find(len(rows), links)
    least = {}
    for (i, _), root in zip(rows, roots):
        least[root] = min(x for x in (i, least.get(root)) if x is not None) if i is not None or root in least else None
    expected = collections.Counter((i, p, least[root]) for (i, _), p, root in zip(rows, prints, roots))
    found = simhash.near_duplicates(make(rows, extra=True), largest_posting=posting).collect()
    assert collections.Counter((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in found) == expected


def test_one_of_each_group_stays(make):
    a, b = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    docs = make([(1, a), (2, a), (3, b), (3, b), (4, None), (5, ""), (None, b)], extra=True)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4"]
    assert simhash.keep_first(docs.limit(0)).collect() == []


def test_rows_that_share_an_id_are_documents_of_their_own(make):
    """A unique text is never lost with a copy of the same id, and a copy without id goes."""
    texts = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abc"}
    rows = [(0, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (2, "c"), (None, "b"), (1, "b")]
    kept = simhash.keep_first(make([(i, texts[c]) for i, c in rows], extra=True)).collect()
    assert sorted((r.doc_id, r.text[0]) for r in kept) == [(0, "a"), (1, "b"), (2, "c")]
    assert {r.fingerprint for r in kept} == {"x3"}


def test_one_row_of_each_component_stays(make):
    """Beside brute force over fingerprints, with ids that are null, repeated and in no order."""
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            copy[rng.randrange(150)] = "other"
            texts += [" ".join(copy)] * rng.randint(1, 2)
    rows = [(rng.choice([None, rng.randint(0, 30)]), t) for t in [*texts, *ODD]]
    prints = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for j in range(len(rows)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 3]
    groups = collections.defaultdict(list)
    for row, root in zip(rows, union_find(len(rows), links)):
        groups[root].append(row)
    found = [(r.doc_id, r.text) for r in simhash.keep_first(make(rows)).collect()]
    assert len(found) == len(groups)
    for members in groups.values():
        least = min((i is None, i or 0) for i, _ in members)
        assert sum((i is None, i or 0) == least and (i, t) in found for i, t in set(members)) >= 1


# 10


def plain_removed(rows):
    places = {}
    for i, text in rows:
        for number, line in enumerate((text or "").split("\n")):
            if words := WORD.findall(lower(line)):
                places.setdefault(" ".join(words), set()).add((i is None, i or 0, number))
    texts = list(places)
    sets = [line_dedup.shingle_set(t, line_dedup.SHINGLE) for t in texts]
    links = []
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            both = len(a & b)
            if both and both >= 0.8 * (len(a) + len(b) - both):
                links.append((i, j))
    groups = collections.defaultdict(set)
    for text, root in zip(texts, union_find(len(texts), links)):
        groups[root] |= places[text]
    return {(None if none else i, n) for g in groups.values() for none, i, n in g - {min(g)}}


@pytest.mark.parametrize("bucket", [0, 1000])
def test_line_dedup(make, bucket):
    rng = random.Random(6)
    base = " ".join(f"word{i}" for i in range(30))
    texts = list(ODD)
    for i in range(25):
        words = base.split()
        words[rng.randrange(30)] = f"x{i}"
        texts.append("\n".join([" ".join(words), "", f"own line {i} of this text", base.upper() if i % 5 == 0 else "Ünique é"]))
    rows = [*enumerate(texts), (None, base), (None, "one")]
    docs = make(rows, extra=True)
    found = {(r.doc_id, r.number) for r in line_dedup.removed_lines(docs, smallest=bucket).collect()}
    assert found == plain_removed(rows)
    cleaned = line_dedup.drop_lines(docs).collect()
    assert len(cleaned) == len(rows)
    by_id = {r.doc_id: r for r in cleaned if r.doc_id is not None}
    for i, text in enumerate(texts):
        kept = [line for n, line in enumerate(text.split("\n")) if (i, n) not in found] if text is not None else []
        assert by_id[i].text == ("\n".join(kept) if text is not None else None)
        assert by_id[i]._n_removed == sum(1 for d, _ in found if d == i)
    assert line_dedup.drop_lines(docs.limit(0)).collect() == []


@tables
def test_line_dedup_misses_nothing(documents):
    found = {(r.doc_id, r.number) for r in line_dedup.removed_lines(documents).collect()}
    assert found == plain_removed([(d.doc_id, d.text) for d in documents.collect()])


@pytest.mark.parametrize("bucket", [0, 8, 1000])
def test_line_dedup_verifies_pairs_of_one_bucket(make, bucket):
    # With a single band no two lines share a second bucket.
    rng = random.Random(9)
    lines = []
    for _ in range(60):
        line = "the very same beginning " + "".join(rng.choice("abcdefgh") for _ in range(12))
        lines += [line, line[:-1] + "z"]
    raw = [line.encode() for line in lines]
    edges = np.cumsum([0, *map(len, raw)])
    table = line_dedup.signatures(b"".join(raw), edges[:-1], edges[1:], line_dedup.SHINGLE, 1)
    keys = line_dedup.band_keys(table, 1)[:, 0].tolist()
    assert max(collections.Counter(keys).values()) >= 9
    expected = {(i + 1, 0) for i in range(0, len(lines), 2) if keys[i] == keys[i + 1]}
    assert len(expected) > 50
    found = line_dedup.removed_lines(make(lines), rows=1, bands=1, smallest=bucket).collect()
    assert {(r.doc_id, r.number) for r in found} == expected


def test_line_dedup_tells_rows_of_one_id_apart(make):
    rows = [
        (None, "x\nunique1"),
        (None, "p\nx"),
        (None, "q\n\nx"),
        (1, "y\nunique2"),
        (1, "r\ny"),
        (2, "s\n\nt"),
        (2, "s\n\nt"),
        (2, "s\n\nt"),
        (None, "u\nv"),
        (None, "u\nv"),
        (None, None),
        (None, None),
        (None, ""),
        (None, ""),
    ]
    cleaned = line_dedup.drop_lines(make(rows, extra=True))
    assert cleaned.columns[:-2] == make(rows, extra=True).columns
    # Of x the least number stays, then y in the row where it comes first; one of equal rows.
    expected = [(None, "x\nunique1", 0), (None, "p", 1), (None, "q\n", 1), (1, "y\nunique2", 0), (1, "r", 1)]
    expected += [(2, "s\n\nt", 0), (2, "", 2), (2, "", 2), (None, "u\nv", 0), (None, "", 2)]
    expected += [(None, None, 0), (None, None, 0), (None, "", 0), (None, "", 0)]
    found = [(r.doc_id, r.text, r._n_removed) for r in cleaned.collect()]
    assert collections.Counter(found) == collections.Counter(expected)
    assert {r.id for r in cleaned.collect()} == {"x0"}


def test_line_dedup_keeps_one_of_lines_at_one_place(make):
    texts = [r.text for r in line_dedup.drop_lines(make([(None, "same\na"), (None, "same\nb"), (5, "c\nd")])).collect()]
    assert sorted("\n".join(texts).split("\n")) == ["a", "b", "c", "d", "same"]


def test_line_counts_beside_columns_of_their_name(make):
    docs = make(["same line here\nown", "same line here"]).selectExpr("*", "7 AS _n_lines", "8 AS __n_removed")
    cleaned = line_dedup.drop_lines(docs)
    assert cleaned.columns == [*docs.columns, "___n_lines", "___n_removed"]
    assert sorted(tuple(r)[2:] for r in cleaned.collect()) == [
        (7, 8, 1, 1),
        (7, 8, 2, 0),
    ]
    assert line_dedup.drop_lines(docs, counts=False).columns == docs.columns


def test_similar_links_connect_what_all_pairs_do():
    """Families of near copies, of texts at 0.5 to 0.9 and of short ones, in one meeting."""
    rng = random.Random(11)
    texts = ["", "a", "short", "short"]
    for family in range(6):
        base = "".join(rng.choice("abcdefgh ij") for _ in range(300))
        for _ in range(40):
            text = list(base)
            for _ in range(rng.randint(0, 12)):
                text[rng.randrange(300)] = "XYZ"[family % 3]
            texts.append("".join(text))
    sets = [line_dedup.shingle_set(t, 10) for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if line_dedup._similar(sets[i], sets[j], 0.8)]
    links = line_dedup.similar_links(line_dedup.shingle_hashes(texts, 10), 0.8)
    assert union_find(len(texts), links) == union_find(len(texts), pairs) and len(links) < len(texts)


def test_lines_are_read_once(make):
    """Texts of lines come from the pass that finds their places, and connected lines are still compared."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards watch from afar"
    docs = make([f"{base} number {i}\nonly here {i} {'x' * 30}{i * i}" for i in range(30)])
    rows = docs.select(docs.doc_id.alias("id"), "text").selectExpr("*", "xxhash64(text) AS mark")
    places = line_dedup._places(rows, line_dedup.SHINGLE, line_dedup.ROWS, line_dedup.BANDS)
    words = {r.words for r in places.select("words").where("words IS NOT NULL").collect()}
    assert words == {line for r in docs.collect() for line in r.text.lower().split("\n")}
    kept = line_dedup.drop_lines(docs).orderBy("doc_id").collect()
    assert [r["_n_removed"] for r in kept] == [0] + [1] * 29


def test_bins_borrow_what_their_own_sequence_draws():
    """Empty bins are filled in blocks of attempts, with the values that attempts one by one find."""
    raw = "a|bcd|some words of a line|word word word word word|東京 🙂 and some more of it".encode()
    texts = raw.split(b"|")
    left = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    right = left + [len(t) for t in texts]
    size = 52
    table = line_dedup.signatures(raw, left, right, 10, size)
    for text, row in zip(texts, table.tolist()):
        symbols = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
        values = [line_dedup.xxhash.xxh64_intdigest(text)]
        if len(symbols) >= 10:
            values = line_dedup.window_hashes(symbols, 10).tolist()
        bins = {}
        for v in values:
            at = (v >> 32) * size >> 32
            bins[at] = min(bins.get(at, 1 << 64), v & 0xFFFFFFFE)
        for bin_ in range(size):
            at, attempt = bin_, 0
            while at not in bins:
                attempt += 1
                at = int(line_dedup._mixed(np.array([bin_ + size * attempt], np.uint64))[0]) % size
            assert row[bin_] == bins[at]
