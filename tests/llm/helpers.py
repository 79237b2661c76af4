import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DATA = "/root/testdata/sf0.001"
WORDS = "the of and banks loans rules under each limit small year new set by for with among Éclair größer niño rate".split()


def words(text):
    return WORD.findall(text or "")


def odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows, a null id, and columns whose names the operators use themselves."""
    body = " ".join(WORDS[i * i % 19] + str(i % 23) for i in range(120))
    rows = [
        (1, body), (2, body), (2, body), (3, body.replace("the0", "THE0", 1)), (4, None), (5, ""), (6, " \n\t "), (None, body), (7, "one two"), (8, "ONE Two"), (9, "x" * 200_000),
        (10, body * 400), (11, "a b c\n" * 80), (12, "line one here\nline one here\n\n|| ## é"), (13, "a b c d e"), (14, " ".join(body.split()[:70])),
    ]
    return spark.createDataFrame([(i, t, 1, "x", "y", 2, 3, "z", 4.0) for i, t in rows], "doc_id long, text string, id int, body string, node string, size int, loc int, item string, score double"), rows
