"""License scans against a plain scan in Python."""

import re


from methmix.llm import licenses
from tests.llm.data import documents, hard_texts, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [
    "Released under the MIT License.", "UNDER-THE (mit) LICENSE under the mit license", "Apache License, Version 2.0",
    "Licensed under CC BY-NC 4.0.", "licensed under the GNU General Public License, version 3.", "GNU Lesser General Public License v2.1",
    "SPDX-License-Identifier: BSD-3-Clause", "All rights reserved.", "released into the public domain", "mit freundlichen Grüßen, lizenz",
    "underthe mit license", "under the mit licenseé", "apache license version 20", "ccby nc", "cc by nc cc by nc", "x cc by nc sa 3.0 y",
    "under the mit license " * 3 + "apache license version 2",
]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(text):
    """Base starts, and surviving hits by comparing all pairs."""
    w = words(text)
    joined = " " + " ".join(w) + " "
    hits = []
    for rank, (label, keyword, pattern, score) in enumerate(licenses.rules()):
        if keyword in joined:
            for m in re.finditer(f" {pattern}(?= )", joined):
                start = joined[:m.start()].count(" ")
                hits.append((start, start + m.group().count(" "), rank, label, score))
    kept = [h for h in hits if not any(
        o != h and o[0] <= h[0] and h[1] <= o[1] and ((o[0], o[1]) != (h[0], h[1]) or o[2] < h[2]) for o in hits)]
    base = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w))
            if w[i:i + len(phrase.split())] == phrase.split()]
    return w, sorted(base), sorted(kept)


def test_against_plain_scan(spark, tmp_path):
    data = rows(TEXTS + hard_texts())
    docs = documents(spark, data)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    scanned = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    reported = {r["doc_id"]: r for r in licenses.op9_license_scan(spark, str(tmp_path)).collect()}
    for doc_id, text, *_ in data:
        w, base, kept = plain(text)
        r = scanned[doc_id]
        assert r["n_words"] == len(w) and r["Key"] == "k"
        gated = any(g in " " + " ".join(w) + " " for g in licenses.GATE)
        assert sorted((h["start"], h["end"], h["rank"], h["label"], h["score"]) for h in r["hits"]) == (kept if gated else [])
        q = reported[doc_id]
        assert q["n_base"] == len(base) and q["n_words"] == len(w)
        assert (q["first_word"], q["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert q["base_labels"] == ",".join(sorted({b[1] for b in base}))
        assert set(q["base_labels"].split(",")) <= set(q["labels"].split(",")) or not base
        assert 0 <= q["score"] <= 1


def test_labels(spark):
    found = licenses.scan_licenses(documents(spark, rows(TEXTS))).orderBy("doc_id").collect()
    labels = [sorted({h["label"] for h in r["hits"]}) for r in found]
    assert labels[3] == ["cc-by-nc-4"] and labels[4] == ["gpl-3"] and labels[5] == ["lgpl-2.1"]
    assert labels[6] == ["bsd-3"] and labels[7] == ["all-rights-reserved"] and labels[8] == ["public-domain"] and labels[9] == []


def test_rules_are_many_and_valid():
    listed = licenses.rules()
    assert len(listed) > 300
    for label, keyword, pattern, score in listed:
        assert label and keyword and 0 < score <= 1 and re.compile(pattern).groups == 0


def test_empty_table_and_clash(spark):
    empty = documents(spark, [])
    assert licenses.scan_licenses(empty).collect() == []
    clash = licenses.scan_licenses(documents(spark, rows(["under the mit license"])).withColumnRenamed("Key", "Hits"))
    assert "Hits" not in clash.columns and clash.first()["base"][0]["label"] == "mit"


def forms_of(pattern):
    """Texts that a rule's pattern matches: each alternative and optional part at least once."""
    tree = re._parser.parse(pattern)

    def texts(items):
        found = [""]
        for op, arg in items:
            op = str(op)
            if op == "LITERAL":
                more = [chr(arg)]
            elif op == "IN":
                more = [chr(a) for _, a in arg]
            elif op == "MAX_REPEAT":
                more = ["", *texts(arg[2])]
            elif op == "SUBPATTERN":
                more = texts(arg[3])
            else:
                assert op == "BRANCH"
                more = [t for branch in arg[1] for t in texts(branch)]
            # The longest and the shortest of each part, and every one beside the first text.
            found = list(dict.fromkeys([found[0] + m for m in more] + [f + m for f in found[1:] for m in (more[0], more[-1])]))
        return found
    return texts(tree)


def test_gates_hide_no_rule():
    for _, keyword, pattern, _ in licenses.rules():
        for text in forms_of(pattern):
            assert re.fullmatch(pattern, text)
            assert keyword in f" {text} " and any(g in f" {text} " for g in licenses.GATE), (pattern, text)


def test_names_without_the_word_licence(spark):
    texts = {"Released under MIT": "mit", "distributed under the BSD 3 clause": "bsd-3", "released under Apache 2.0": "apache-2",
             "distributed under LGPL 3": "lgpl", "released under AGPL": "agpl", "offered to you under AGPL v3": "agpl-3",
             "released under Creative Commons Attribution 4.0": "cc-by-4", "the Expat license": "mit", "PSF license license": "python"}
    found = licenses.scan_licenses(documents(spark, rows(list(texts)))).orderBy("doc_id").collect()
    assert [[h["label"] for h in r["hits"]] for r in found] == [[label] for label in texts.values()]


def test_against_every_rule_without_gates(spark):
    names = ["MIT", "Expat", "AGPL 3", "GPLv2", "Apache 1.1", "CC BY-SA 2.5", "Creative Commons Attribution ShareAlike", "submit"]
    texts = [f"x {form} {name} y" for form in ("released under", "subject to the", "provided to you under the terms of the") for name in names]
    texts += [f"{t} licence" for t in texts] + TEXTS
    listed = [re.compile(f" {pattern}(?= )") for _, _, pattern, _ in licenses.rules()]
    for r in licenses.scan_licenses(documents(spark, rows(texts))).collect():
        joined = " " + " ".join(words(texts[r["doc_id"]])) + " "
        hits = [(joined[:m.start()].count(" "), joined[:m.end()].count(" "), rank)
                for rank, pattern in enumerate(listed) for m in pattern.finditer(joined)]
        kept = [h for h in hits if not any(o != h and o[0] <= h[0] and h[1] <= o[1] and (o[:2] != h[:2] or o[2] < h[2]) for o in hits)]
        assert sorted((h["start"], h["end"], h["rank"]) for h in r["hits"]) == sorted(kept)
