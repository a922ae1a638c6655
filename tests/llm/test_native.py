"""Licence scan, sharding and quality rules: hand-made rows and brute force."""

import re
import time
import zlib
from collections import Counter

from tessera.llm import licenses, quality_rules, sharding

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_licenses(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    gap = "Permission is hereby granted, free of charge, to any kind person obtaining a copy of this software and associated documentation files"
    texts = [None, "", "apache", apache, f"x {apache} y\n{apache}", "CC BY-NC 4.0", "gnu general public", "GNU\ngeneral, PUBLIC license mit LICENSE",
             gap, "é " * 50_000 + "mit license", "same mit license", "same mit license", "of the " * 40]
    docs = spark.createDataFrame([(i % 11, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, label string")
    rows = licenses.license_scan(spark, docs).collect()
    assert len(rows) == len(texts)
    want = Counter()
    for i, t in enumerate(texts):
        words = WORD.findall((t or "").lower())
        places = sorted((a, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for a in range(len(words)) if words[a:a + len(p)] == p)
        want[(i % 11, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == want
    by = {(r.doc_id, r.n_words): r for r in rows}
    assert by[8, len(gap.split())].labels == "mit" and by[8, len(gap.split())].n_base == 0 and by[8, len(gap.split())].score >= 0.8  # one word put in
    assert by[5, 5].labels == "cc-by" and by[0, 0].labels == "" and by[0, 0].score == 0.0
    assert licenses.license_scan(spark, docs.limit(0)).count() == 0


def test_a_template_place_counts_once(spark):
    texts = ["all rights, all rights", "rights reserved rights reserved", "all rights reserved", "All rights; reserved? ALL RIGHTS RESERVED"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {r.doc_id: r for r in licenses.license_scan(spark, docs).collect()}
    assert [by[i].labels for i in range(4)] == ["", "", "all-rights-reserved", "all-rights-reserved"]
    assert by[0].score == by[1].score == 0.0 and by[2].score == 1.0


def test_very_long_lines(spark):
    """Time in proportion to the length: a line of one word, of words, of symbols, of capitals."""
    lines = ["x" * 1_000_000, "word " * 200_000, "AB" * 500_000, "| " * 300_000, "A1 " * 300_000]
    docs = spark.createDataFrame([(i, line + "\nA short line, it ends here.", 1, 2) for i, line in enumerate(lines)], "doc_id long, text string, n long, lines long")
    began = time.time()
    by = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert time.time() - began < 60
    assert [by[i].n_words for i in range(5)] == [7, 200_006, 7, 300_006, 300_006]
    assert [by[i].n_removed_lines for i in range(5)] == [0, 1, 0, 1, 1]


def test_sharding_equals_one_key_at_a_time(spark):
    rows = [(i, f"text {i}" * (i % 7)) for i in range(3000)] + [(7, "again")] * 900 + [(None, None)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for shards in (1, 8, 9):
        out = sharding.shard_rows(spark, docs, shards, cell_rows=50).collect()
        assert len(out) == len(rows)
        n = Counter(r.shard for r in out)
        assert max(n.values()) - min(n[s] for s in range(shards)) <= 1
        for s in range(shards):
            assert sorted(r.slot for r in out if r.shard == s) == list(range(n[s]))
        # keys one by one: all try their own shard in ring order, those left the next, ...
        position = dict(docs.distinct().selectExpr("doc_id", "shiftrightunsigned(xxhash64(doc_id), 1) p").collect())
        order = sharding.clockwise(sharding.ring(shards), shards)
        keys = sorted(((position[k], -1 if k is None else k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows))
        room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
        got: dict = {}
        for trial in range(shards):
            for i, key in enumerate(keys):
                slot = key[0] >> (63 - sharding.SLOT_BITS)
                s = order[slot][trial]
                if i not in got and room[s]:
                    room[s] -= 1
                    got[i] = s
        # within a slot the rank decides, so runs of keys agree as multisets
        want = Counter((*keys[i][1:], s) for i, s in got.items())
        assert Counter((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.shard) for r in out) == want
    assert sharding.shard_rows(spark, docs.limit(0)).count() == 0


def test_one_more_shard_moves_few_rows(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'t' as text")
    a = {r.doc_id: r.shard for r in sharding.shard_rows(spark, docs, 8).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard_rows(spark, docs, 9).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.5 * len(a)  # dealing anew by remainder moves 8 of 9


def test_quality_rules(spark):
    clean = "\n".join(f"Plain{i} line{i} number{i} has{i} words{i}, and{i} it{i} ends{i} here." for i in range(12))
    junk = "\n".join([f"Home{i} | About{i} | Contact{i} | Login{i} | More" for i in range(9)] + ["BUY NOW!! BEST DEAL EVER!! ORDER TODAY!!"] + [f"w{i}### x{i}*** y{i}$$$ z{i}%%% v{i}&&&" for i in range(9)])
    texts = [None, "", " \n\t", clean, junk + "\n" + " ".join(f"v{i}." for i in range(30)), "a b c " * 100, clean + "\nAll rights reserved.", "one two three one two three four " + "w " * 3, clean, clean]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs, with_text=True).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {p for j in range(len(words) - 2) if windows[tuple(words[j:j + 3])] > 1 for p in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    assert rows[3].kept and rows[3].n_removed_lines == 0
    assert not rows[4].kept and not rows[4].base_failed
    assert rows[6].kept and rows[6].n_removed_lines == 1 and rows[6].cleaned == clean
    assert not rows[0].kept and rows[5].base_failed
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0
