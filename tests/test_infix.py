"""Infix patterns of all words are met by the places of their fragments; no pair is matched token by token."""

from lexiloom.plans import reference_queries as R


def test_infix_pairs_are_not_matched_anew(spark, tmp_path, monkeypatch):
    texts = [(1, "aba thath bathe x aathb"), (20, "abath that axth")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(R.S, "wildcard_match", None)
    got = {tuple(r) for r in R.QUERIES["wildcard_infix_all"](spark, str(tmp_path)).collect()}
    # "a-th" ends in one token, "t-at" begins with a t that "th" is not
    assert got == {("a-th", w, 2, 2) for w in ("thath", "bathe", "aathb", "abath", "axth")}
