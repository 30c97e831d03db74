import random

import pytest

WORDS = ["tion", "able", "über", "the", "of", "ñandú", "xyz", "Wh,", "re.", "été", "stone", "l'eau", "42", "café"]


@pytest.fixture(scope="session")
def texts():
    """Texts with what real ones have: nulls, empty and very long ones, copies, shared passages, odd white space."""
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", str(rng.randrange(50))]) for _ in range(n))
    passage, long = prose(90), prose(9000)
    out = [None, "", " ", "\n\t ", "a", "one two three", "x" * 3000, "ab" * 900, "word " * 400, "日本語のテキスト" * 60, long, long[:20000] + " changed " + long[20000:]]
    out += [prose(rng.randrange(1, 120)) for _ in range(25)]
    out += [out[14], out[14], out[15] + " more"]
    out += [prose(20) + " " + passage + "\n" + prose(15) for _ in range(6)] + [passage, passage + " " + passage]
    out += ["tab\tand  two   spaces \n newline 's 'll  nbsp  em <|endoftext|> x", "\x1c \x85 odd"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """doc_id out of order, with a null and a repeated row, and columns whose names clash with results'."""
    rows = [(i * 3 % len(texts) if len(texts) % 3 else i, t, "en" if i % 3 else None, f"s{i % 4}", i, "clash") for i, t in enumerate(texts)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
