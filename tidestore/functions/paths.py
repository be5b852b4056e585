"""Time labels of partitions, resource paths and their encoding."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidestore.model import check_partition

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
DAY_US, HOUR_US = 86_400_000_000, 3_600_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_micros(time: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), _col(time))


def from_micros(us: Column | str) -> Column:
    return F.timestamp_add("MICROSECOND", _col(us).cast("bigint"), F.expr(EPOCH))


def label_format(partition_us: int) -> str:
    """Whole days, whole hours, or minutes."""
    if partition_us % DAY_US == 0:
        return "yyyy-MM-dd"
    return "yyyy-MM-dd-HH" if partition_us % HOUR_US == 0 else "yyyy-MM-dd-HH-mm"


def window_start(us: Column | str, partition_us: int) -> Column:
    """Start of the window that holds an instant, in microseconds; exact before 1970 too."""
    us = _col(us)
    return us - F.pmod(us, F.lit(check_partition(partition_us)).cast("bigint"))


def partition_label(time: Column | str, partition_us: int) -> Column:
    """Label of the window that holds ``time``, without the ``p=``."""
    start = from_micros(window_start(epoch_micros(time), partition_us))
    return F.date_format(start, label_format(partition_us))


def partition_name(time: Column | str, partition_us: int) -> Column:
    return F.concat(F.lit("p="), partition_label(time, partition_us))


def window_of(time: datetime, partition_us: int) -> datetime:
    """Start of the window that holds an instant, on the driver."""
    us = (time - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    return datetime(1970, 1, 1) + timedelta(microseconds=us - us % check_partition(partition_us))


def python_label(time: datetime, partition_us: int) -> str:
    """The label of one instant, on the driver."""
    shapes = {"yyyy-MM-dd": "%Y-%m-%d", "yyyy-MM-dd-HH": "%Y-%m-%d-%H", "yyyy-MM-dd-HH-mm": "%Y-%m-%d-%H-%M"}
    return window_of(time, partition_us).strftime(shapes[label_format(partition_us)])


def partition_start(name: Column | str) -> Column:
    """Start of the window that a ``p=`` name stands for; null if it isn't one.

    Three to five numbers between dashes, together a date and time; zeros in front may be missing and
    dashes at the end don't count.
    """
    name = _col(name)
    body = F.regexp_replace(F.substring(name, 3, 1 << 20), "-+$", "")
    part = F.split(body, "-", -1)
    number = lambda i: F.get(part, F.lit(i)).try_cast("int")
    later = lambda i: F.when(F.size(part) > i, number(i)).otherwise(F.lit(0))
    digits = F.forall(part, lambda x: x.rlike("^[+-]?[0-9]{1,9}$"))
    start = F.try_make_timestamp_ntz(number(0), number(1), number(2), later(3), later(4), F.lit(0).cast("decimal(16,6)"))
    return F.when(name.startswith("p=") & F.size(part).between(3, 5) & digits, start)


def encode_element(element: Column | str) -> Column:
    """A path element in which only letters, digits, dot, underscore and dash stand for themselves."""
    element = _col(element)
    # the form encoding, which differs for blanks and asterisks only
    plain = F.replace(F.replace(F.url_encode(element), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return F.when(element.isin(".", ".."), F.regexp_replace(element, r"\.", "%2E")).when(element == "", F.lit("")).otherwise(plain)


def shard_path(resource_id: Column | str) -> Column:
    """Encoded elements of a resource id; an empty or null id is an error."""
    resource_id = _col(resource_id)
    kept = F.filter(F.split(resource_id, "/"), lambda e: e != "")
    path = F.array_join(F.transform(kept, encode_element), "/")
    return F.when(resource_id.isNull() | (resource_id == ""), F.raise_error(F.lit("resource id is empty")).cast("string")).otherwise(path)


def partition_path(resource_id: Column | str, time: Column | str, partition_us: int) -> Column:
    return F.concat_ws("/", F.nullif(shard_path(resource_id), F.lit("")), partition_name(time, partition_us))


def data_root(base_dir: str) -> str:
    return f"{base_dir.rstrip('/')}/data"


def catalog_root(base_dir: str) -> str:
    return f"{base_dir.rstrip('/')}/catalog"


# Resource paths as arrays of elements


def sanitize_name(text: Column | str) -> Column:
    """Letters, digits, dots and dashes stay; all else becomes an underscore."""
    return F.regexp_replace(_col(text), "[^a-zA-Z0-9.-]", "_")


def path_elements(text: Column | str) -> Column:
    """Elements of a slash-separated path; empty ones at the end don't count and '' has none."""
    text = _col(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, "/+$", ""), "/"))


def path_text(elements: Column | str) -> Column:
    return F.array_join(_col(elements), "/")


def path_name(elements: Column | str) -> Column:
    """The last element; null for the empty path."""
    return F.try_element_at(_col(elements), F.lit(-1))


def has_parent(elements: Column | str) -> Column:
    return F.size(_col(elements)) > 1


def path_parent(elements: Column | str) -> Column:
    """All elements but the last; an error where there is no parent."""
    e = _col(elements)
    error = F.raise_error(F.lit("path has no parent")).cast("array<string>")
    return F.when(has_parent(e), F.slice(e, F.lit(1), F.greatest(F.size(e) - 1, F.lit(0)))).otherwise(error)


def relative_depth(parent: Column | str, child: Column | str) -> Column:
    """Elements that ``child`` has below ``parent``; -1 if it isn't below."""
    p, c = _col(parent), _col(child)
    return F.when(F.slice(c, F.lit(1), F.size(p)) == p, F.size(c) - F.size(p)).otherwise(F.lit(-1))


def file_path(elements: Column | str, separator: str = "/") -> Column:
    """Elements as a relative path of a file system; where that parts names by backslashes, colons become underscores."""
    e = _col(elements)
    return F.array_join(F.transform(e, lambda x: F.replace(x, F.lit(":"), F.lit("_"))) if separator == "\\" else e, separator)


def child_path(parent: Column | str, *names: Column | str) -> Column:
    return F.concat(_col(parent), F.array(*(_col(n) for n in names)))


def remove_extension(file: Column | str) -> Column:
    return F.regexp_replace(_col(file), r"\.[^.]*$", "")


def import_path(elements: Column | str, by_foreign_source: bool, foreign_source: Column, foreign_id: Column) -> Column:
    """Path under which an archive's samples are stored.

    With foreign sources, ``snmp/<node>/...`` becomes ``snmp/fs/<source>/<id>/...``; an unknown node gives
    null. All other paths stay. The node's source and id come from a join with ``node_of``.
    """
    e = _col(elements)
    if not by_foreign_source:
        return e
    replaced = F.concat(F.array(F.lit("snmp"), F.lit("fs"), foreign_source, foreign_id), F.slice(e, 3, F.greatest(F.size(e) - 2, F.lit(0))))
    return F.when(_is_node_path(e), F.when(foreign_source.isNotNull() & foreign_id.isNotNull(), replaced)).otherwise(e)


def node_of(elements: Column | str) -> Column:
    """Node number of a path that foreign sources rename; null for other paths, an error if it's no number."""
    e = _col(elements)
    return F.when(_is_node_path(e), F.get(e, F.lit(1)).cast("int"))


def _is_node_path(e: Column) -> Column:
    first, second = F.get(e, F.lit(0)), F.get(e, F.lit(1))
    return (F.size(e) > 1) & (first == "snmp") & (second != "fs")
