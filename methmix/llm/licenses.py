"""License scans by ordered signature rules; DataFrame functions only.

A text becomes its words, A-Z lowered, between single spaces. One test for a few keywords lets most documents
pass without any rule; the rules of the others are gated by a keyword each. No gate hides a hit: a rule's keyword is
part of all its matches. A rule is a regular expression over
whole words; its hits are word intervals. Of overlapping hits, one inside another's interval is dropped, and of
hits with the same interval the one of the earlier rule stays. A document's hits stay in its row, so nothing is
shuffled.

A null text has no words and no hits. Texts are scanned whole, of any length. Repeated rows are scanned
each. An empty table gives an empty result. Input columns are kept, but for those with the
name of a column made here.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methmix.llm.common import table, without
from methmix.llm.registry import query

# The phrases that every scan counts, and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Label, regular expressions of the name in words. Longer names come first.
FAMILIES = [
    ("agpl-3", ["(?:gnu )?affero general public license(?: agpl)?(?: version)? v?3", "agpl v?3"]),
    ("agpl", ["(?:gnu )?affero general public license", "agpl"]),
    ("lgpl-3", ["(?:gnu )?lesser general public license(?: lgpl)?(?: version)? v?3"]),
    ("lgpl-2.1", ["(?:gnu )?lesser general public license(?: lgpl)?(?: version)? v?2 1"]),
    ("lgpl-2", ["(?:gnu )?library general public license(?: lgpl)?(?: version)? v?2"]),
    ("lgpl", ["lgpl(?: v?[23](?: 1)?)?", "gnu lgpl"]),
    ("gfdl", ["(?:gnu )?free documentation license(?:(?: version)? v?1 [123])?"]),
    ("gpl-3", ["(?:gnu )?general public license(?: gpl)?(?: version)? v?3"]),
    ("gpl-2", ["(?:gnu )?general public license(?: gpl)?(?: version)? v?2"]),
    ("gpl", ["(?:gnu )?general public license"]),
    ("gpl-3", ["(?:gnu )?gpl(?: version)? v?3", "gplv3"]),
    ("gpl-2", ["(?:gnu )?gpl(?: version)? v?2", "gplv2"]),
    ("gpl", ["gnu gpl"]),
    ("apache-2", ["apache(?: software)? license(?: version)? v?2(?: 0)?", "apache 2(?: 0)?"]),
    ("apache-1", ["apache(?: software)? license(?: version)? v?1(?: [01])?", "apache 1(?: [01])?"]),
    ("apache", ["apache(?: software)? license", "apache"]),
    ("mit-0", ["mit no attribution", "mit 0"]),
    ("mit", ["mit x11", "mit", "expat"]),
    ("bsd-4", ["bsd 4 clause", "original bsd", "4 clause bsd"]),
    ("bsd-3", ["bsd 3 clause", "new bsd", "modified bsd", "revised bsd", "3 clause bsd"]),
    ("bsd-2", ["bsd 2 clause", "simplified bsd", "freebsd", "2 clause bsd"]),
    ("bsd-0", ["zero clause bsd", "0 clause bsd", "0bsd"]),
    ("bsd", ["bsd"]),
    ("mpl-2", ["mozilla public license(?: version)? v?2(?: 0)?"]),
    ("mpl-1", ["mozilla public license(?: version)? v?1 [01]"]),
    ("mpl", ["mozilla public license"]),
    ("epl-2", ["eclipse public license(?: version)? v?2(?: 0)?"]),
    ("epl-1", ["eclipse public license(?: version)? v?1(?: 0)?"]),
    ("cddl", ["common development and distribution license(?:(?: version)? v?1 [01])?"]),
    ("cpl", ["common public license(?:(?: version)? v?1 0)?"]),
    ("eupl", ["european union public licence(?:(?: version)? v?1 [12])?"]),
    ("artistic-2", ["artistic license(?: version)? v?2(?: 0)?"]),
    ("artistic", ["artistic license"]),
    ("isc", ["isc"]),
    ("zlib", ["zlib libpng", "zlib"]),
    ("boost", ["boost software license(?:(?: version)? v?1 0)?", "boost"]),
    ("unlicense", ["unlicense"]),
    ("wtfpl", ["wtfpl"]),
    ("python", ["python software foundation license(?:(?: version)? v?2)?", "psf license"]),
    ("php", ["php license(?:(?: version)? v?3(?: 01)?)?"]),
    ("ofl", ["sil open font license(?:(?: version)? v?1 1)?", "open font license"]),
    ("odbl", ["open database license(?:(?: version)? v?1 0)?"]),
    ("openrail", ["openrail m?", "open rail m?"]),
]

# Creative Commons clauses, in words and in labels.
CC_CLAUSES = [("by nc nd", "cc-by-nc-nd", ["attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"]),
              ("by nc sa", "cc-by-nc-sa", ["attribution non ?commercial share ?alike"]),
              ("by nc", "cc-by-nc", ["attribution non ?commercial"]),
              ("by nd", "cc-by-nd", ["attribution no ?deriv(?:ative)?s?(?: works)?"]),
              ("by sa", "cc-by-sa", ["attribution share ?alike"]),
              ("by", "cc-by", ["attribution"])]
CC_VERSIONS = ["4", "3", "2 5", "2", "1"]

GRANTS = ["licensed", "released", "distributed", "published", "available", "provided", "shared", "offered"]
# Sentence forms around a name, best evidence first, with their scores.
FORMS = [
    ("spdx license identifier {name}(?: only| or later)?", 1.0),
    ("(?:" + "|".join(GRANTS) + ")(?: to you)? under(?: the)?(?: terms of)?(?: the)? {name}(?: licen[sc]e)?", 0.95),
    ("(?:under|subject to|governed by|covered by)(?: the)?(?: terms of)?(?: the)? {name} licen[sc]e", 0.9),
    ("licen[sc]e (?:is )?(?:the )?{name}", 0.7),
    ("{name} licen[sc]e", 0.6),
]
# Every rule needs one of these: the words of its form, or those of a name that stands alone.
GATE = ["licen", " cc by ", " cc0 ", " creative commons ", " public domain ", " all rights reserved ",
        *(f" {grant}{you} under " for grant in GRANTS for you in ("", " to you"))]


def keyword_of(name: str) -> str:
    """The longest piece, but for the word licence, that every match of a name holds; spaces bound whole words."""
    rest, pieces = None, f" {name} "
    while rest != pieces:
        rest, pieces = pieces, re.sub(r"\(\?:[^()]*\)\?", "\0", pieces)
    pieces = re.split("\0", re.sub(r"[^\0]\?|\[[^]]*\]", "\0", pieces))
    return max(pieces, key=lambda piece: (piece.strip() not in ("license", "licence"), len(piece.strip()), len(piece)))


def rules() -> list[tuple[str, str, str, float]]:
    """Ordered rules: (label, keyword, regular expression, score). Base phrases first, then form by form."""
    names = [(label, name) for label, patterns in FAMILIES for name in patterns]
    for short, label, long_names in CC_CLAUSES:
        for version in CC_VERSIONS:
            tail = f" {version}" + ("" if " " in version else "(?: 0)?")
            names += [(f"{label}-{version.replace(' ', '.')}", f"cc {short}{tail}")]
            names += [(f"{label}-{version.replace(' ', '.')}", f"creative commons {name}{tail}(?: international)?")
                      for name in long_names]
        names += [(label, f"cc {short}")]
        names += [(label, f"creative commons {name}") for name in long_names]
    found = [(label, keyword_of(phrase), phrase, 1.0) for phrase, label in BASE.items()]
    for form, score in FORMS:
        found += [(label, keyword_of(name), form.format(name=f"(?:{name})"), score) for label, name in names]
    found += [
        ("cc0", " cc0 ", "cc0(?: 1(?: 0)?)?(?: universal)?", 0.9),
        ("public-domain", " the public domain ", "(?:dedicated to|released into|in) the public domain", 0.8),
        ("all-rights-reserved", " all rights reserved ", "all rights reserved", 0.8),
    ]
    found += [(label, keyword_of(name), name, 0.8) for label, name in names
              if name.startswith(("cc ", "creative")) or "general public license" in name]
    return found


def words_only(text: Column) -> Column:
    """' word word ', case kept."""
    return F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")),
                            r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")


def spaces(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))).cast("bigint")


def places(norm: Column, pattern: Column) -> Column:
    """array<struct<start, end>> in words of the hits of `pattern`, which begins with the space before a word."""
    gaps = F.transform(F.split(norm, pattern, -1), spaces)
    hits = F.transform(F.regexp_extract_all(norm, pattern, F.lit(0)), spaces)
    # gaps[i] words lie between hit i - 1 and hit i.
    zipped = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"),
                     F.array().cast("array<struct<start:bigint,end:bigint>>").alias("found"))
    return F.aggregate(
        zipped, start,
        lambda a, z: F.struct((a["at"] + z["gap"] + z["hit"]).alias("at"), F.array_append(
            a["found"], F.struct((a["at"] + z["gap"]).alias("start"), (a["at"] + z["gap"] + z["hit"]).alias("end"))).alias("found")),
        lambda a: a["found"])


def whole_words(pattern: str) -> str:
    return f" {pattern}(?= )"


def base_places(phrase: str, label: str) -> Column:
    placed = F.transform(places(F.col("__llm_norm"), F.lit(whole_words(phrase))), lambda p: F.struct(
        p["start"].alias("start"), p["end"].alias("end"), F.lit(label).alias("label")))
    none = F.array().cast("array<struct<start:bigint,end:bigint,label:string>>")
    return F.when(F.contains("__llm_norm", F.lit(f" {phrase} ")), placed).otherwise(none)


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, base (array<struct<label, start, end>>) and hits (array<struct<label, start, end,
    rank, score>>), the hits that no other one suppresses, by start."""
    docs = without(docs, ("n_words", "base", "hits"))
    listed = rules()
    by_keyword: dict[str, list] = {}
    for rank, (label, keyword, pattern, score) in enumerate(listed):
        by_keyword.setdefault(keyword, []).append(F.struct(
            F.lit(whole_words(pattern)).alias("pattern"), F.lit(label).alias("label"), F.lit(rank).alias("rank"),
            F.lit(score).alias("score")))
    table_of_rules = F.array(*[F.struct(F.lit(keyword).alias("keyword"), F.array(*group).alias("rules"))
                               for keyword, group in by_keyword.items()])
    kind = "array<struct<label:string,start:bigint,end:bigint,rank:int,score:double>>"
    lowered = F.lower("__llm_raw")
    gate = F.lit(False)
    for keyword in GATE:
        gate = gate | F.contains(lowered, F.lit(keyword))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    asked = F.flatten(F.transform(F.filter(table_of_rules, lambda g: F.contains(F.col("__llm_norm"), g["keyword"])),
                                  lambda g: g["rules"]))
    found = F.flatten(F.transform(
        asked,
        lambda r: F.transform(places(F.col("__llm_norm"), r["pattern"]), lambda p: F.struct(
            r["label"].alias("label"), p["start"].alias("start"), p["end"].alias("end"),
            r["rank"].alias("rank"), r["score"].alias("score"))))).cast(kind)
    # In order of start, then longest, then rank, a hit is inside an earlier one if that one ends no sooner.
    ordered = F.transform(
        F.array_sort(F.transform("__llm_all", lambda h: F.struct(
            h["start"].alias("start"), (-h["end"]).alias("back"), h["rank"].alias("rank"),
            h["label"].alias("label"), h["score"].alias("score")))),
        lambda h: F.struct(h["label"], h["start"], (-h["back"]).alias("end"), h["rank"], h["score"])).cast(kind)
    kept = F.aggregate(
        ordered, F.struct(F.lit(0).cast("bigint").alias("reach"), F.array().cast(kind).alias("kept")),
        lambda a, h: F.struct(F.greatest(a["reach"], h["end"]).alias("reach"),
                              F.when(h["end"] > a["reach"], F.array_append(a["kept"], h)).otherwise(a["kept"]).alias("kept")),
        lambda a: a["kept"])
    base = F.array_sort(F.flatten(F.array(*[base_places(phrase, label) for phrase, label in BASE.items()])))
    return (
        docs.withColumn("__llm_raw", words_only(F.col(text_col)))
        .withColumn("n_words", spaces(F.col("__llm_raw")) - 1)
        .withColumn("__llm_norm", F.when(gate, F.translate("__llm_raw", upper, upper.lower())))
        .withColumn("__llm_all", F.when(F.col("__llm_norm").isNotNull(), found))
        .withColumn("base", F.when(F.col("__llm_norm").isNotNull(), base))
        .withColumn("hits", F.coalesce(F.when(F.size("__llm_all") > 0, kept), F.array().cast(kind)))
        .drop("__llm_raw", "__llm_norm", "__llm_all")
    )


@query("op9_license_scan")
def op9_license_scan(spark, sf_dir):
    """Every base phrase holds a gate keyword, so the gate hides none of them."""
    scanned = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("base", lambda b: b["start"])
    base = F.array_distinct(F.transform("base", lambda b: b["label"]))
    own = F.transform("hits", lambda h: h["label"])
    none = F.array().cast("array<string>")
    return scanned.select(
        "doc_id", "n_words", F.coalesce(F.size("base"), F.lit(0)).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.coalesce(base, none)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce(base, none), own)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)).alias("score"))
