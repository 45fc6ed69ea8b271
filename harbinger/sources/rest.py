"""A paged JSON REST dataset as a Spark data source (`format("harbinger_rest")`), batch and streaming.

Options: base (address of the service), dataset, dateField, since, appToken, pageSize, pagesPerTask. Rows: seq long, raw
string. Pages are streamed, never held together, and each is tried again by itself.

A batch read asks for the number of rows and makes a partition of each range of pages; the last one goes on until a
page is short and then asks again: fewer rows than before would have moved the pages, so the read fails. A service
that gives no number is read by one partition.

The stream goes by when the service last changed a row (its fields :updated_at and :id), not by the rows' own dates, so a
row comes after the offset however old its date is. The driver reads only the newest key and the first key of each range;
tasks read the ranges, page after page, from key to key. A row that changes meanwhile leaves its range and is in a later one.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGE_ROWS, ATTEMPTS, TIMEOUT_S, ERROR_CHARS = 5000, 3, 120, 300
#: Pages that one task reads.
PAGES_A_TASK = 8
SCHEMA = "seq long, raw string"


class BadShape(ValueError):
    """A page that is no JSON array."""


def get_page(url: str, token: str | None = None, sleep=time.sleep) -> list:
    """One page; 429, 5xx and lost connections are tried again after one and two seconds, other statuses fail at once."""
    request = urllib.request.Request(url, headers={"X-App-Token": token} if token else {})
    for attempt in range(1, ATTEMPTS + 1):
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT_S) as response:
                rows = json.loads(response.read())
            if not isinstance(rows, list):
                raise BadShape(f"{url}: expected an array")
            return rows
        except urllib.error.HTTPError as e:
            if attempt == ATTEMPTS or not (e.code == 429 or e.code >= 500):
                raise RuntimeError(f"{url}: status {e.code}: {e.read().decode(errors='replace')[:ERROR_CHARS]}") from e
        except (urllib.error.URLError, ConnectionError, TimeoutError) as e:
            if attempt == ATTEMPTS:
                raise RuntimeError(f"{url}: {e}") from e
        sleep(attempt)
    raise AssertionError


def _url(options: dict, **params) -> str:
    asked = {f"${k}": v for k, v in params.items() if v is not None}
    return f"{options['base'].rstrip('/')}/resource/{options['dataset']}.json?" + urllib.parse.urlencode(asked)


def _text(row: dict) -> str:
    """Compact, without the service's own fields."""
    return json.dumps({k: v for k, v in row.items() if not k.startswith(":")}, ensure_ascii=False, separators=(",", ":"))


def _since(options: dict) -> str | None:
    return f"{options['dateField']} >= '{options['since']}'" if options.get("dateField") and options.get("since") else None


def count_rows(options: dict, where: str | None) -> int | None:
    """As the service counts them; None if it does not."""
    rows = get_page(_url(options, select="count(*)", where=where, limit=1, offset=0), options.get("appToken"))
    if len(rows) == 1 and isinstance(rows[0], dict) and list(rows[0]) == ["count"] and str(rows[0]["count"]).isdigit():
        return int(rows[0]["count"])
    return None


def _size(options: dict) -> int:
    return int(options.get("pageSize", PAGE_ROWS))


class Pages(InputPartition):
    """Pages from the row `lo` up to `hi`, or to the end, where there must be `least` rows at least."""

    def __init__(self, lo: int, hi: int | None, least: int | None):
        self.lo, self.hi, self.least = lo, hi, least


class RestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options  # keys match in any case

    def partitions(self):
        rows, step = count_rows(self.options, _since(self.options)), _size(self.options) * int(self.options.get("pagesPerTask", PAGES_A_TASK))
        if not rows:
            return [Pages(0, None, rows)]
        starts = list(range(0, rows, step))
        return [Pages(lo, lo + step if lo != starts[-1] else None, rows) for lo in starts]

    def read(self, partition):
        options, size, at = self.options, _size(self.options), partition.lo
        order = f"{options['dateField']},:id" if options.get("dateField") else ":id"
        while partition.hi is None or at < partition.hi:
            want = size if partition.hi is None else min(size, partition.hi - at)
            rows = get_page(_url(options, order=order, where=_since(options), limit=want, offset=at), options.get("appToken"))
            for k, row in enumerate(rows):
                yield at + k, _text(row)
            at += len(rows)
            if len(rows) < want:
                if partition.hi is None:
                    break
                raise RuntimeError(f"{options['dataset']}: a page in the middle is short; rows went while they were read")
        if partition.hi is None and partition.least:
            now = count_rows(options, _since(options))
            if at < partition.least or now is not None and now < partition.least:
                raise RuntimeError(f"{options['dataset']}: {partition.least} rows when the read began, fewer now")


def _key(row: dict) -> dict:
    return {"at": str(row[":updated_at"]), "id": str(row[":id"])}


def _between(lo: dict, hi: dict | None, options: dict) -> str | None:
    """Rows after the key lo, up to and with hi."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    if lo["at"]:
        parts.append(f"(:updated_at > {quoted(lo['at'])} OR (:updated_at = {quoted(lo['at'])} AND :id > {quoted(lo['id'])}))")
    if hi is not None:
        parts.append(f"(:updated_at < {quoted(hi['at'])} OR (:updated_at = {quoted(hi['at'])} AND :id <= {quoted(hi['id'])}))")
    if _since(options):
        parts.append(_since(options))
    return " AND ".join(parts) or None


class Range(InputPartition):
    """Rows after the key `lo` up to `hi`; number is the range's place in its batch."""

    def __init__(self, number: int, lo: dict, hi: dict):
        self.number, self.lo, self.hi = number, lo, hi


class RestStreamReader(DataSourceStreamReader):
    """Offsets are keys: when a row was changed, and its id. A batch that is run again reads the same ranges."""

    def __init__(self, options: dict):
        self.options = options  # keys match in any case

    def _keys(self, where: str | None, order: str, offset: int = 0) -> list[dict]:
        rows = get_page(_url(self.options, select=":updated_at,:id", order=order, where=where, limit=1, offset=offset), self.options.get("appToken"))
        return [_key(r) for r in rows]

    def initialOffset(self):
        return {"at": "", "id": ""}

    def latestOffset(self):
        return next(iter(self._keys(_since(self.options), ":updated_at DESC,:id DESC")), self.initialOffset())

    def partitions(self, start, end):
        if start == end or not end["at"]:
            return []
        where, step = _between(start, end, self.options), _size(self.options) * int(self.options.get("pagesPerTask", PAGES_A_TASK))
        cuts, at = [start], step
        while True:
            next_key = self._keys(where, ":updated_at,:id", at - 1)
            if not next_key or next_key[0] == end:
                break
            cuts.append(next_key[0])
            at += step
        return [Range(k, lo, hi) for k, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], end], strict=True))]

    def read(self, partition):
        lo, seq, size = partition.lo, partition.number << 40, _size(self.options)
        while True:
            rows = get_page(_url(self.options, select=":*,*", order=":updated_at,:id", where=_between(lo, partition.hi, self.options), limit=size, offset=0), self.options.get("appToken"))
            for row in rows:
                yield seq, _text(row)
                seq += 1
            if len(rows) < size:
                return
            lo = _key(rows[-1])

    def commit(self, end):
        pass

    def stop(self):
        pass


class RestSource(DataSource):
    @classmethod
    def name(cls):
        return "harbinger_rest"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return RestReader(self.options)

    def streamReader(self, schema):
        return RestStreamReader(self.options)
