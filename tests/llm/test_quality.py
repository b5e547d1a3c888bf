import math
import random
import re

from pyspark.sql import functions as F

from storecast.llm import quality

WORD = r"[^\x20\x09-\x0d]+"


def plain(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words))


def texts():
    rng = random.Random(2)
    out = [None, "", " ", "\n\n", "a", "  x y", " lead", "trail ", "a\x0bb\x0cc\rd", "#*$%&|<> é", "same\nsame\n same\n\nsame", "z" * 50_000]
    for _ in range(60):
        out.append(rng.choice([" ", "\n", "\t "]).join(rng.choices(["a", "b", "the", "Éa", "x#", "of"], k=rng.randint(0, 60))))
    out += ["one two three four five six seven eight " * k + "nine" for k in (1, 2, 3, 9)]
    out.append(" ".join(str(i % 9) for i in range(3000)))
    return out


def test_base_columns_equal_plain_rules(spark):
    rows = [(i, t, "en", "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string")
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for i, t, _, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), t
        assert not (r.base_failed and r.kept)


def test_distance_equals_the_formula(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    got = spark.range(1).select(quality.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).head()[0]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    assert abs(got - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12


def test_junk_goes_clean_stays_and_edge_cases(spark):
    rng = random.Random(1)
    common = quality.COMMON_WORDS["en"]
    clean = lambda: " ".join(rng.choices(common, k=40) + ["w" + "".join(rng.choices("abcdefgh", k=6)) for _ in range(40)])
    rows = [(i, clean(), "en") for i in range(200)]
    rows += [(1000 + i, re.sub(" ", "*** ", clean()), "en") for i in range(60)]
    rows += [(2000 + i, clean().upper().replace(" ", "!! "), "en") for i in range(30)]
    rows += [(1, rows[1][1], "en"), (3000, None, None), (3001, "", "en"), (3002, clean(), None), (3003, clean(), "xx"), (None, clean(), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(range(200)) <= set(ids) and ids.count(1) == 2 and None in ids and {3002, 3003} <= set(ids)
    assert not {i for i in ids if i and 1000 <= i <= 3001}
    assert quality.quality_rules(docs.limit(0)).collect() == []
