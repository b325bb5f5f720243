"""Files by address, for sources and sinks that read or write parts of them in tasks."""

from __future__ import annotations

import re
import time
import uuid
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame


def located(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it; addresses without a scheme are local."""
    if re.match(r"file:/|/", address):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", unquote(address) if address.startswith("file:") else address)
    return fs.FileSystem.from_uri(address)


def absent(address: str) -> tuple[fs.FileSystem, str]:
    """``located``, or an error if there is something already."""
    files, where = located(address.rstrip("/"))
    if files.get_file_info(where).type.name != "NotFound":
        raise FileExistsError(address)
    return files, where


def deleted(folder: str, tries: int = 5) -> None:
    """Delete a folder that late tasks may still write to."""
    files, root = located(folder)
    for left in reversed(range(tries)):
        if files.get_file_info(root).type.name == "NotFound":
            return
        try:
            files.delete_dir(root)
        except OSError:
            if not left:
                raise
            time.sleep(0.5)


def save(rows: DataFrame, sink: str, path: str, **options: str) -> None:
    """Write ``rows`` by a sink that stages its files; the folder is new, and whole or not there."""
    files, _ = absent(path)
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    files.create_dir(located(staging)[1], recursive=True)
    try:
        rows.write.format(sink).options(path=path.rstrip("/"), staging=staging, **options).mode("append").save()
    except Exception:
        deleted(staging)
        raise
