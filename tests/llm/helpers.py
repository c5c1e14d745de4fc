"""Small document sets with every awkward case."""

import random
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n=60, seed=4):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 7))) for _ in range(300)] + ["É", "été", "Größe", "x1", "日本"]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = [line(12) for _ in range(4)]
    out = []
    for i in range(n):
        text = "\n".join([line(r.randrange(1, 30)) for _ in range(r.randrange(1, 6))] + [r.choice(shared) for _ in range(r.randrange(0, 3))])
        if i % 7 == 3 and out:
            text = out[r.randrange(len(out))][1] or ""
            if r.random() < 0.7:
                w = text.split(" ")
                w[r.randrange(len(w))] = "changed"
                text = " ".join(w)
        out.append((i, text, "en" if i % 2 else "fr", "s", len(text)))
    out += [
        (1000, None, None, None, None), (1001, "", "en", None, 0), (1002, " \n \t\n", None, "s", 4), (1003, ",;.!", "en", "s", 4), (1004, "one", "en", "s", 3), (1005, "one two\x0bthree  FOUR", "en", "s", 3),
        (1006, "ONE two three four\n", "en", "s", 3), (None, "a text without an id, of some length", "en", "s", 9), (1008, (line(9) + "\n") * 3000, "en", "s", 1), (1009, "z" * 70_000, "en", "s", 70_000),
        (1010, "  PADDED line of text  \r\nplain\npadded LINE of text", "fr", "s", 1), (1011, "padded line of text\n\n\n", "fr", "s", 1),
    ]
    out.append(out[5])  # a repeated row
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def crc(i):
    return zlib.crc32(str(i).encode())


def check_path(spark, tmp_path, name, df):
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
