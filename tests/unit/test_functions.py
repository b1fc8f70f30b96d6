import pytest
from pyspark.sql import functions as F
from quillstone.functions import text as T


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*[F.col(n) for n in names])).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("10.1234/ABC", "10.1234/abc"), ("https://doi.org/10.1234/abc", "10.1234/abc"), (" doi:10.1/x). ", "10.1/x"), (None, "")])
def test_doi(spark, raw, want):
    assert one(spark, T.normalize_doi, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("http://arxiv.org/abs/2401.00001v2", "2401.00001"), ("arXiv:2401.1", "2401.1"), ("v1", "v1"), (None, "")])
def test_arxiv(spark, raw, want):
    assert one(spark, T.normalize_arxiv_id, raw) == want


def test_title(spark):
    assert one(spark, T.normalize_title, " Tidal  Gauges; 2nd survey?") == "tidal gauges 2nd survey"


TEX = [
    (r"Salt \emph{marsh} maps", "Salt marsh maps"),
    (r"Ebb_flow at 7% of \textit{quay} & pier {twelve}", r"Ebb\_flow at 7\% of quay \& pier twelve"),
    (r"{Harbour} log #9", r"Harbour log \#9"),
    (r"tide^high costs $5~net", r"tide\textasciicircum{}high costs \$5\textasciitilde{}net"),
    (r"\textbf{Deep \textbf{W}ater} gauges {open", "Deep Water gauges open"),
    (r"9\% \TeX \ldots", r"9\% TeX …"),
]


@pytest.mark.parametrize(("raw", "want"), TEX)
def test_sanitize(spark, raw, want):
    assert one(spark, T.sanitize_bibtex, raw) == want


def test_sanitize_of_odd_texts_without_a_lambda_per_sign(spark, capsys):
    signs = {"\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "%": r"\%", "&": r"\&", "#": r"\#", "$": r"\$", "_": r"\_", "^": r"\textasciicircum{}", "~": r"\textasciitilde{}"}
    texts = ["", " \t{a}\n b\u2003c \u00a0", r"\\ \{x\} \~^~ %\% \_\^", "\ue000\ue001 \U0001f600_~\r\n#", "a\\\nb $&"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.flatten_tex(F.col("t")).alias("flat"), T.sanitize_bibtex(F.col("t")).alias("safe"))
    for flat, safe in rows.collect():
        assert safe == "".join(signs.get(x, x) for x in flat)
    assert rows.first()["flat"] == "" and rows.collect()[1]["flat"] == "a  b c"
    rows.explain()
    assert "lambda" not in capsys.readouterr().out


def test_uuid5(spark):
    import uuid

    for name in ("a", "topic:paper:pdf:1:h:i", "é"):
        assert one(spark, T.uuid5, name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_trailing_words(spark):
    assert one(spark, lambda c: T.trailing_words(c, 2), "a b  c") == "b c"
    assert one(spark, lambda c: T.trailing_words(c, 5), "a b") == "a b"
    assert one(spark, lambda c: T.trailing_words(c, 0), "a b") == ""


def test_unfence(spark):
    assert one(spark, T.unfence_json, '```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.unfence_json, '{"a": 1}') == '{"a": 1}'
    assert one(spark, T.unfence_json, "no") is None
    assert one(spark, T.unfence_json, None) is None


def test_evidence(spark):
    assert one(spark, T.format_evidence, " a , ,b") == "[@a; @b]"
    assert one(spark, T.format_evidence, None) == "Not specified"
