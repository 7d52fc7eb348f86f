"""Property tests: per-row helpers against plain-Python models of the
reference semantics (trim = Character.isWhitespace, Java String.split)."""
import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from satledger.functions.columns import content_id, normalize_sender, quote_lines, sats_from_msat

JAVA_WS = "\t\n\u000b\f\r\u001c\u001d\u001e\u001f               　"


def py_normalize(s):
    t = s.strip(JAVA_WS).lower()
    return t[1:] if t.startswith("@") else t


def py_split_lines(s):
    if s == "":
        return [""]
    parts = re.split(r"\r?\n", s)
    while parts and parts[-1] == "":
        parts.pop()
    return parts


names = st.text(alphabet=st.sampled_from(list("aAbZ@ _-\t\n\r  éİ")), max_size=12)
messages = st.text(alphabet=st.sampled_from(list("ab \r\n>")), max_size=14)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(names, messages, st.integers(0, 10**12)), min_size=1, max_size=25))
def test_row_helpers_match_models(spark, rows):
    df = spark.createDataFrame(rows, "s string, m string, msat long")
    got = df.select(normalize_sender("s").alias("n"), quote_lines("m").alias("q"),
                    sats_from_msat("msat").alias("sat"),
                    content_id({"sender_name": df["s"], "message": df["m"],
                                "value_msat_total": df["msat"]}).alias("c")).collect()
    for (s, m, msat), r in zip(rows, got):
        assert r.n == py_normalize(s)
        assert r.q == "\n".join("> " + x for x in py_split_lines(m))
        assert r.sat == msat // 1000
        text = " ".join(["", "", "", "", "", "", "", s, str(msat), "", m, "", "", ""])
        assert r.c == hashlib.sha256(text.encode("utf-8")).hexdigest()
