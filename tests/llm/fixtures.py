"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t string, sig long, q double, frag int, copies int"

WORDS = "the of and in stone river cloud lamp table green quick walks under seven bridge winter paper silver north engine".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("," if r.random() < 0.1 else "") for _ in range(n)) + "."


def long_prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ta", "ri", "mo", "ne", "su", "k", "l", "o"]) for _ in range(r.randrange(1, 5))) for _ in range(n)) + "."


def rows():
    base = prose(1, 120)
    edited = base.replace("river", "ocean", 3)
    texts = [base, base, edited, prose(2, 150), prose(3, 80), "", None, "one", "one two", "one two", long_prose(4, 9000), "The The " * 400, prose(5, 60) + " " + prose(6, 40), "!!! ???", prose(7, 90) + "\n" + prose(6, 40)]
    out = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3], None if t is None else len(t), "x", "y", 1, 0.5, 2, 3) for i, t in enumerate(texts)]
    out.append(out[3])  # a repeated row
    out.append((None, base, "en", "a", len(base), None, None, None, None, None, None))
    out.append((None, prose(9, 70), None, None, None, None, None, None, None, None, None))
    out.append((50, prose(10, 70), "en", "a", -5, None, None, None, None, None, None))
    return out


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
