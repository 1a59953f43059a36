import pytest

from tallywell.functions import redaction as R


def test_masks(spark):
    df = spark.createDataFrame(
        [(7, "alice@example.com", "+86 138-1234-5678", "secret", "110101199001011234", "Bo", "Main Street 5"), (8, "@x.y", "12", None, "1", "", "ab"), (9, "none", None, "p", None, "X", "")],
        "order_count int, email string, phone string, password string, id_card string, customer_name string, address string")
    rows = R.redact(df, {"id_card": "confidential"}, salt="s").collect()
    assert rows[0][:3] == (7, "a***@example.com", "***5678") and rows[0][3].startswith("tok_") and len(rows[0][3]) == 16
    assert rows[0][4:] == ("11**************34", "B*", "Ma***")
    assert rows[1][1:3] == ("****@x.y", "***") and rows[1][3] is None and rows[1][4:] == ("***", "*", "***")
    assert rows[2][1] == "***" and rows[2][2] is None and rows[2][5] == "X*"
    assert R.redact(df, reveal="L3").collect() == df.collect()


def test_levels():
    assert R.classify("api_token")[0] == R.Level.RESTRICTED and R.classify("team_code")[0] == R.Level.INTERNAL
    assert R.classify("shipdate")[2] == "tokenize"  # 'ip' inside a name
    assert R.classify("password", "public")[0] == R.Level.PUBLIC
    assert [R.parse_level(x) for x in ("L2", "机密", 2, " Confidential ")] == [R.Level.CONFIDENTIAL] * 4
    for bad in ("L9", True, None, "x", 7):
        with pytest.raises(R.SensitivityError):
            R.parse_level(bad)
    with pytest.raises(R.SensitivityError):
        R.classify(" ")
    with pytest.raises(R.SensitivityError):
        R.classify_columns(["a", "a"])
