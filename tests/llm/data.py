"""Small tables with the hard cases, and plain versions of what the operators compute."""

from __future__ import annotations

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `Key` string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(seed: int, count: int) -> list[str]:
    """`count` words that differ from those of other seeds."""
    return [f"w{(seed * 7919 + i * i * 31 + i) % 100003}" for i in range(count)]


def rows(texts, langs=None, sources=None):
    """Rows (doc_id, text, lang, source, n_chars, Key) of numbered texts."""
    return [(i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", None if t is None else len(t), "k")
            for i, t in enumerate(texts)]


def documents(spark, data):
    return spark.createDataFrame(data, DOCS)


def hard_texts() -> list[str | None]:
    """Null, empty, white space, one word, exact and near copies, shared passages, ties and a very long text."""
    base = sentence(1, 200)
    near = base[:90] + ["changed"] + base[91:]
    passage = sentence(2, 60)
    long = [f"x{i % 7001}" for i in range(60_000)]
    return [
        None, "", " \t\n\x0b\x0c\r ", "word", "Word", "two words", " ".join(base), " ".join(base).upper(), " ".join(near),
        "\n".join(base), " ".join(sentence(3, 40) + passage + sentence(4, 40)), " ".join(sentence(5, 10) + passage),
        " ".join(passage), " ".join(sentence(6, 30) * 3), " ".join(sentence(6, 30)), " ".join(long), " ".join(long[:59_000]),
        "no break \x1c sep", "naïve Straße Σίσυφος", "a a a a a a a a a a a a a a a a a a a a a a a a a",
    ]


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
