import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, owner string, size string, score string, lang_pred string, row string, copies string, target string, keep_id string, component_id string, n string, text_sha256 string, node string, held_out string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with extra columns whose names clash with the operators' own."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), *"xyzabcdefghijk") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build
