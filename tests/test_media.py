import datetime
import hashlib
import os

from pyspark.sql import functions as F

from millrace.sources import media

NOW = datetime.datetime(2024, 6, 1)
HEADS = {".png": b"\x89PNG\r\n\x1a\nxx", ".jpg": b"\xff\xd8\xff\xe0", ".gif": b"GIF89a..", ".webp": b"RIFF1234WEBP"}


def key(url):
    return hashlib.md5(url.encode()).hexdigest()[:16]


def put(root, platform, raw_id, url, extension, age, body=b"x"):
    path = root / platform / str(raw_id) / f"{key(url)}{extension}"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body)
    at = (NOW - datetime.timedelta(days=age)).replace(tzinfo=datetime.timezone.utc).timestamp()
    os.utime(path, (at, at))
    return path


def test_only_old_files_of_the_platform_go(spark, tmp_path):
    old, new, other = (put(tmp_path, p, 1, u, ".jpg", age) for p, u, age in (("weibo", "u1", 31), ("weibo", "u2", 29), ("zhihu", "u1", 90)))
    files = media.listing(spark, str(tmp_path))
    assert {(r.platform, r.raw_id, r.key) for r in files.collect()} == {("weibo", 1, key("u1")), ("weibo", 1, key("u2")), ("zhihu", 1, key("u1"))}
    assert "content" not in files._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert media.remove(media.expired(files, NOW, 30, "weibo")) == 1
    assert not old.exists() and new.exists() and other.exists()
    assert media.remove(media.expired(media.listing(spark, str(tmp_path)), NOW, 30)) == 1 and not other.exists()


def test_files_of_urls(spark, tmp_path):
    put(tmp_path, "weibo", 1, "a", ".gif", 0)
    first = put(tmp_path, "weibo", 1, "a", ".png", 0)
    put(tmp_path, "weibo", 2, "b", ".jpg", 0)
    put(tmp_path, "weibo", 1, "c", ".txt", 0)
    posts = spark.createDataFrame([("weibo", 1, ["c", "a", "", None, "a"]), ("weibo", 2, None), ("zhihu", 1, ["a"])], "platform string, raw_id long, media_urls array<string>")
    files = media.listing(spark, str(tmp_path))
    got = sorted((r.raw_id, r.n, r.url, r.path.removeprefix("file:")) for r in media.paths_of(posts, files).collect())
    assert got == [(1, 1, "a", str(first)), (1, 4, "a", str(first))]
    assert sorted((r.platform, r.raw_id, r.url, r.key) for r in media.missing(posts, files).collect()) == [("weibo", 1, "c", key("c")), ("zhihu", 1, "a", key("a"))]


def test_extensions(spark, tmp_path):
    for extension, head in HEADS.items():
        put(tmp_path, "x", 1, extension, ".bin", 0, head)
    put(tmp_path, "x", 1, "none", ".bin", 0, b"zz")
    rows = media.listing(spark, str(tmp_path), content=True).select("key", media.extension_of_content(F.col("content")).alias("e")).collect()
    assert {r.key: r.e for r in rows} == {key(e): e for e in HEADS} | {key("none"): None}
    types = spark.createDataFrame([("image/png",), ("image/webp; q",), ("image/jpeg",), ("image/gif",), ("text/html",), (None,)], "t string")
    assert [r.e for r in types.select(media.extension_of_type(F.col("t")).alias("e")).collect()] == [".png", ".webp", ".jpg", ".gif", ".jpg", ".jpg"]
