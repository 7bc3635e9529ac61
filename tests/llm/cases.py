"""Documents with every awkward case, and plain Python versions of what the operators promise."""

from __future__ import annotations

import collections
import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "size long, score string, ids string, copy long, n_words int, place string, n_tokens string, lines string, bands int, marks int, decoded int, whole int, level int, _turn int, _cut string, _copy string, _lines int, _score int, _runs int, _lines_of_text int, row int, turn int, parts int, body int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    r = random.Random(3)
    vocabulary = ["".join(r.choices("abcdeéß", k=r.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choices(vocabulary, k=n))
    passage = prose(60)
    long = "\n".join(prose(40) for _ in range(600))
    near = prose(80).split()
    out = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, "a", 4),
        (4, passage + "\n" + prose(10), "en", "b", 1),
        (5, prose(12) + "\n" + passage + "\n" + prose(9), "en", None, 1),
        (6, passage, "en", "b", 1),
        (7, long, "fr", "hot", 1),
        (8, long, "fr", "hot", 1),
        (9, " ".join(near), None, None, None),
        (10, " ".join(near[:40] + ["changed"] + near[40:]), "de", "a", 1),
        (11, "one two", "de", "a", 1),
        (12, "ONE  two", "de", "", 1),
        (13, "same same same same same same", "de", "a", 1),
        (14, "x y\nx y\n\nx y\n$$ ## %", "de", "a", 1),
        (None, "no id at all", "en", "a", 1),
        (None, None, None, None, None),
        (15, "Ünïcode 中文 ＡＢ   é <|endoftext|> don't", "en", "c", 1),
    ]
    out += [(20 + i, prose(r.randint(1, 90)), r.choice(["en", "de"]), r.choice(["hot", "hot", "a", "z"]), 1) for i in range(60)]
    return out + [out[3], out[10], out[13]]  # repeated rows


def documents(spark, data=None):
    """As a table with columns that clash with names the operators use."""
    data = rows() if data is None else data
    n = len(CLASHING.split(","))
    return spark.createDataFrame([(*x, *[None] * n) for x in data], f"{DOCS}, {CLASHING}")


def words(text):
    return WORD.findall(text or "")


def low(text):
    return (text or "").encode().lower().split()


def near_components(data, percent=75):
    """(doc_id, n_shingles, component) by comparing all pairs."""
    sets = []
    for _, text, *_ in data:
        w = low(text)
        sets.append(set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(data)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, one in enumerate(sets):
        for j in range(i):
            both = len(one & sets[j])
            if both and 100 * both >= percent * (len(one) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc_id, *_) in enumerate(data):
        if doc_id is not None:
            smallest[root(i)] = min(smallest.get(root(i), doc_id), doc_id)
    return [(d[0], len(s), smallest.get(root(i)) if s else d[0]) for i, (d, s) in enumerate(zip(data, sets, strict=True))]


def repeated_runs_removed(data, least=50):
    """{(doc_id, text): text without later repeated runs} by comparing the lines of all windows."""
    docs = sorted({(d[0] is not None, d[0] or 0, d[1]) for d in data if d[1] is not None}, key=lambda d: d[:2])
    first, gone = {}, collections.defaultdict(set)
    for has, doc_id, text in docs:
        lines = [(i, x) for i, x in enumerate(text.split("\n")) if words(x)]
        for k in range(len(lines)):
            n, end = 0, k
            while end < len(lines) and n < least:
                n += len(words(lines[end][1]))
                end += 1
            if n >= least:
                key = tuple(x for _, x in lines[k:end])
                if key in first:
                    gone[has, doc_id, text].update(range(lines[k][0], lines[end - 1][0] + 1))
                else:
                    first[key] = doc_id
    return {
        (doc_id if has else None, text): "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[has, doc_id, text])
        for has, doc_id, text in docs
    }


def maximal_runs_removed(texts, least=50):
    """{place: text without lines of a run with `least` words that an earlier place has} by trying all pairs of places."""
    lines = [[(i, x) for i, x in enumerate(t.split("\n")) if words(x)] for t in texts]
    out = {}
    for d, mine in enumerate(lines):
        gone = set()
        for e in range(d + 1):
            for k in range(len(mine)):
                for j in range(k if e == d else len(lines[e])):
                    n = m = 0
                    while k + n < len(mine) and j + n < len(lines[e]) and mine[k + n][1] == lines[e][j + n][1]:
                        m += len(words(mine[k + n][1]))
                        n += 1
                    if m >= least:
                        gone.update(range(mine[k][0], mine[k + n - 1][0] + 1))
        out[d] = "\n".join(x for i, x in enumerate(texts[d].split("\n")) if i not in gone)
    return out
