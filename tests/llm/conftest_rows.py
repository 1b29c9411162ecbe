"""Odd documents: nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""

import random


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = (
    "n_words key row host text_hash document mark cls n token step root unit side start length ids sequence_id offset "
    "spans kept lo hi anchor bytes held_out base rare edits node parent packing_shard line"
).split()


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    made = ["".join(pick.choice(["ta", "rem", "ol", "is", "un", "ché", "vor", "ni"]) for _ in range(pick.randint(1, 4))) for _ in range(words)]
    out = []
    for k, w in enumerate(made):
        out.append(w.capitalize() if k % 9 == 0 else w)
        out.append(".\n" if k % 31 == 30 else " ")
    return "".join(out).strip()


def odd_rows() -> list[tuple]:
    a, passage = prose(1, 260), prose(2, 80)
    words = a.split(" ")
    near = " ".join([*words[:100], "other", *words[101:]])
    rows = [
        (1, a, "en", "s0", len(a)),
        (2, a, "en", "s0", len(a)),
        (3, near, "en", "s1", len(near)),
        (4, prose(3, 60) + "\n" + passage + "\n" + prose(4, 60), "en", "s0", None),
        (5, prose(5, 90) + " é" + passage + "é " + prose(6, 30), None, None, 0),
        (6, None, None, None, None),
        (None, None, None, None, None),
        (7, "", "en", "s0", 0),
        (8, " \n\t\x0b ", "en", "s0", 5),
        (9, "one", "en", "s0", 3),
        (10, "One", "en", "s0", 3),
        (11, "two words", "de", "s0", 9),
        (12, prose(7, 30000), "en", "s2", 1),
        (13, "x " * 4000, "en", "s2", 8000),
        (14, prose(8, 50), "en", "s2", 1),
        (14, prose(8, 50), "en", "s2", 1),
        (None, prose(9, 40), "en", "s2", 1),
        (15, "<|endoftext|> 日本語 😀  " + prose(10, 20), "en", "s3", 1),
        (16, "nul \x00 end \x01 " + prose(11, 20), "en", "s3", 1),
    ]
    return rows
