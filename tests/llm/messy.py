"""A small documents table with every awkward case, shared by the operator tests."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "id string, fp long, mark long, bucket int, rid long, n long, score double, cf_fp long, hash long")


def words(rng, n):
    syl = "ba ke li mo nu ra se ti vo za".split()
    return " ".join("".join(rng.choice(syl) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows(n=40, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = words(rng, rng.randint(1, 120))
        out.append((i, t, rng.choice(["aa", "bb"])))
    base = words(rng, 200)
    out += [(100, base, "aa"), (101, base, "aa"), (102, base, None), (102, base, None),  # copies, a repeated row
            (103, base + " end", "aa"),
            (104, None, "aa"), (105, "", "bb"), (106, " \t\n ", "bb"), (107, "1234 5678 !!", "aa"), (108, "é", None),
            (None, "no id " + words(rng, 30), "aa"), (None, None, None), (109, "Ünï çödé 漢字 " * 50, "bb"),
            (110, words(rng, 30000), "aa"),  # very long
            (111, "x" * 5000, "bb"), (112, "A\\B [INST] </s> <|endoftext|> 1,000 km", "aa")]
    return out


def table(spark, data=None):
    data = rows() if data is None else data
    full = [(i, t, lang, "src0", len(t) if t is not None else None, "k", 1, 2, 3, 4, 5, 0.5, 6, 7) for i, t, lang in data]
    return spark.createDataFrame(full, SCHEMA).repartition(3)
