"""Where a store lies."""

from __future__ import annotations

import os
from urllib.parse import urlsplit


def resolve(url: str) -> tuple[str, dict[str, str]]:
    """A Hadoop path and the settings for it, from a store's URL.

    http and https name an S3 endpoint, whose first path segment is the bucket and the rest a prefix; https
    means TLS. The region comes from AWS_REGION, else AWS_DEFAULT_REGION, else us-east-1. Any other URL or
    path is left to Hadoop.
    """
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https"):
        return url.rstrip("/"), {}
    bucket, _, prefix = parts.path.strip("/").partition("/")
    if not bucket:
        raise ValueError(f"no bucket in {url}")
    region = os.environ.get("AWS_REGION") or os.environ.get("AWS_DEFAULT_REGION") or "us-east-1"
    settings = {
        "fs.s3a.endpoint": parts.netloc,
        "fs.s3a.connection.ssl.enabled": str(parts.scheme == "https").lower(),
        "fs.s3a.endpoint.region": region,
        "fs.s3a.path.style.access": "true",
    }
    return "/".join(x for x in (f"s3a://{bucket}", prefix) if x), settings


def open_fs(uri: str):
    """A pyarrow file system and a path in it, for a URI (file, hdfs, s3, gs and so on) or a local path."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))
