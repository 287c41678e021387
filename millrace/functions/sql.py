"""Functions for SQL text: `SELECT * FROM posts, LATERAL extract_entities(content)`."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .rules import ENTITIES


@udtf(returnType="entity_type string, entity_value string, first int, behind int")
class ExtractEntities:
    """The entities of a text with their places, which no built-in function gives; types in their order."""

    def __init__(self):
        self.patterns = [(t, re.compile(p), g) for t, p, g in ENTITIES]

    def eval(self, text: str):
        for kind, pattern, group in self.patterns:
            for m in pattern.finditer(text or ""):
                yield kind, m.group(group).strip(), m.start(), m.end()


#: SQL bodies of scalar functions of one text, planned as any other expression.
SCALARS = {
    "normalize_whitespace": r"trim(regexp_replace(t, r'(?U)\s+', ' '))",
    "simplify_urls": r"regexp_replace(t, r'https?://(?:www\.)?([^/?#\s]*)\S*', '[链接:$1]')",
    "defang_ip": r"regexp_replace(t, r'\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\b', '$1[.]$2[.]$3[.]$4')",
    "defang_url": "replace(replace(regexp_replace(regexp_replace(t, '(?i)^https?', 'hxxp'), '(?i)^ftp', 'fxp'), '://', '[://]'), '.', '[.]')",
    "media_key": "substring(md5(t), 1, 16)",
}


def register(spark: SparkSession) -> None:
    spark.udtf.register("extract_entities", ExtractEntities)
    for name, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS STRING RETURN {body}")
