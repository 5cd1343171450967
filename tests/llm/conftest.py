import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, size string, digest string, lane string, keep_id string, text_sha256 string, label string"

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards calmly mix a potion for the old king in the north tower"
LONG = " ".join(f"word{i} of a very long text" for i in range(60_000))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and long texts, copies, ties, a repeated row, and columns named as operators name theirs."""
    texts = [
        PROSE, PROSE.replace(" ", "\t\n ", 3), PROSE, PROSE + " again", PROSE.upper(), None, "", " \t\n", "a", "a b", LONG, LONG + " more",
        "die Würde des Menschen ist unantastbar und sie zu achten ist Verpflichtung", "l'été était chaud à Besançon cette année-là",
        "*** ### $$$ %%% &&& ||| <<< >>> ***  ###", "no no no no no no no no no no no no", "line one of it\nline one of it\nline one of it\n\n\nline two",
        "¡¿ 12 34 -- !!", "汉字和假名 かな カナ 한글 \U0001F600 é", "<|endoftext|> x <|endoftext|>", "▁ ▁a  ▁", "1 2\x0b3\x0c4\r5",
    ]
    rows = [(i * 3 + 1, t, [None, "en", "de"][i % 3], [None, "web", "books", ""][i % 4], len(t or ""), "x", "y", None, "z", "q", "l") for i, t in enumerate(texts)]
    rows += [rows[0], (None, PROSE, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
