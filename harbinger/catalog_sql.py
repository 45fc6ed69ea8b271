"""DuckDB SQL of the catalog's queries. FILINGS and RAW_FIELDS run in both engines: they are the inputs, not the logic."""

from __future__ import annotations

#: Signals by integer arithmetic from o_orderkey (k), with m sites.
FILINGS = """
SELECT k, source, CAST(k AS STRING) AS external_id,
  CASE WHEN source IN ('permit', 'electrical', 'plumbing') THEN concat('Permit ', CAST(k AS STRING))
       WHEN k % 5 = 0 THEN concat('Venue ', CAST(site % 600 AS STRING)) WHEN k % 5 = 1 THEN concat('VENUE ', CAST(site % 600 AS STRING), ' LLC')
       WHEN k % 5 = 2 THEN concat('Venue''s ', CAST(site % 600 AS STRING)) WHEN k % 5 = 3 THEN concat('venues  ', CAST(site % 600 AS STRING), ', Co. Inc.') ELSE concat('Venue-', CAST(site % 600 AS STRING)) END AS name,
  CASE WHEN k % 11 = 0 THEN '' ELSE concat(CAST(site AS STRING), CASE v WHEN 0 THEN ' Mission Street' WHEN 1 THEN ' MISSION ST.' WHEN 2 THEN ' Mission St, Apt 3' WHEN 3 THEN '  mission   st' WHEN 4 THEN ' Mission St Unit 4 B' WHEN 5 THEN '-99 Mission St' ELSE ' First Avenue' END) END AS address,
  day AS date, CASE WHEN g % 5 = 0 THEN '' ELSE n_name END AS neighborhood, CAST(g % 6 AS INT) AS score, k % 7 = 0 AS seen
FROM (SELECT o_orderkey AS k, CAST(floor(o_orderkey / 12) AS BIGINT) AS g, CAST(floor(o_orderkey / 7) AS BIGINT) % 7 AS v, o_custkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day,
    (o_orderkey * 37) % (SELECT CAST(floor(count(*) / 5) AS BIGINT) * 2 + 7 FROM orders) AS site,
    CASE o_orderkey % 12 WHEN 0 THEN 'business' WHEN 1 THEN 'permit' WHEN 2 THEN 'entertainment' WHEN 3 THEN 'health' WHEN 4 THEN 'mobile_food' WHEN 5 THEN 'planning' WHEN 6 THEN 'fire' WHEN 7 THEN 'vending' WHEN 8 THEN 'tables_chairs' WHEN 9 THEN 'electrical' WHEN 10 THEN 'plumbing' ELSE 'abc' END AS source
  FROM orders) o
JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
"""

_PHRASES = (
    "New restaurant with bar", "Tenant improvement: coffee and tea shop", "Install rebar and grab bar", "wet bar in basement", "newly renovated kitchen", "Change of use from retail to gym; new business",
    "Type 1 Hood and walk-in cooler", "grease trap for CAFETERIA", "single family housing", "Takeout window, outdoor dining, formula retail", "hotel Bar/lounge", "  new sushi deli  ",
)


def _pick(n: str, values: tuple[str, ...]) -> str:
    cases = " ".join("WHEN {} THEN '{}'".format(i, v.replace("'", "''")) for i, v in enumerate(values))
    return f"CASE {n} % {len(values)} {cases} END"


#: Fields of raw rows by p_partkey; numbers come as text, some of them malformed.
RAW_FIELDS = f"""
SELECT p_partkey AS id, {_pick('p_partkey', _PHRASES)} AS description, {_pick('p_partkey', ('Restaurant', 'office', 'Retail sales', 'book store', ''))} AS proposed_use,
  CASE WHEN p_partkey % 8 = 0 THEN 'abc' WHEN p_partkey % 8 = 1 THEN '' WHEN p_partkey % 8 = 2 THEN '100000' WHEN p_partkey % 8 = 3 THEN '1e6' WHEN p_partkey % 8 = 4 THEN 'NaN' ELSE CAST(p_partkey * 977 % 200000 AS STRING) END AS estimated_cost,
  CASE WHEN p_partkey % 6 = 0 THEN '50000' WHEN p_partkey % 6 = 1 THEN '1d' ELSE CAST(p_partkey * 691 % 120000 AS STRING) END AS valuation,
  CASE WHEN p_partkey % 6 = 0 THEN '50000' WHEN p_partkey % 6 = 1 THEN '1d' ELSE CAST(p_partkey * 691 % 120000 AS STRING) END AS permit_valuation,
  {_pick('p_partkey', ('Barber shop', 'Catering', 'Hotel', '', 'food prep'))} AS lic_code_description, {_pick('p_partkey', ('7225', '3121', '4451', '4539', '5411', '', '31211'))} AS self_reported_naics_code,
  concat('Shop ', CAST(p_partkey % 50 AS STRING)) AS dba_name, concat('SHOP ', CAST(p_partkey % 40 AS STRING)) AS ownership_name,
  {_pick('p_partkey', ('Place of Assembly', 'Temporary Place of Assembly', 'Commercial Cooking', 'Hood system', 'Hot work', 'special place of assembly, neighborhood fair'))} AS permit_type_description,
  {_pick('p_partkey', ('Hot dogs', 'T-shirts', 'fresh FRUIT', ''))} AS whatwillyoubeselling, {_pick('p_partkey', ('snacks', 'art', 'jewelry'))} AS describewhatyouwillsell,
  {_pick('p_partkey', ('Truck', 'TRUCK', 'Push Cart', ''))} AS facilitytype, {_pick('p_partkey', ('', 'Extended Hours', 'Cabaret'))} AS license_type,
  CAST(p_partkey % 3 AS INT) AS tables, CAST(p_partkey % 4 AS INT) AS display
FROM part
"""



def _day(n: int) -> str:
    return f"concat('2024-0', CAST(id % {n} % 9 + 1 AS STRING), '-1', CAST(id % 10 AS STRING), 'T00:00:00.000')"


#: The same rows with the fields of all feeds; vid stands for the field id.
FEED_ROWS = f"""
SELECT r.*, CASE WHEN id % 13 = 0 THEN '' ELSE concat('u', CAST(id AS STRING)) END AS uniqueid, CASE WHEN id % 17 = 0 THEN '' ELSE concat('P', CAST(id % 700 AS STRING)) END AS permit_number,
  CASE WHEN id % 19 = 0 THEN '' ELSE concat('v', CAST(id AS STRING)) END AS vid, concat(CAST(id % 90 AS STRING), ' Oak St') AS full_business_address,
  {_pick('id', ('12', '', '7'))} AS street_number, {_pick('id', ('Mission', 'Oak'))} AS street_name, {_pick('id', ('St', '', 'Ave', 'Ave'))} AS street_suffix, {_pick('id', ('', '4', '', 'B', ''))} AS unit,
  {_pick('id', ('Mission', 'Marina', ''))} AS neighborhoods_analysis_boundaries, {_pick('id', ('Sunset', ''))} AS analysis_neighborhood, concat('Dba ', CAST(id AS STRING)) AS dba, concat(CAST(id % 40 AS STRING), ' Elm St') AS street_address,
  concat('o', CAST(id AS STRING)) AS objectid, concat('App ', CAST(id % 30 AS STRING)) AS applicant, concat(CAST(id % 20 AS STRING), ' Fir St') AS address, concat('r', CAST(id AS STRING)) AS record_id,
  {_pick('id', ('', 'Tower', 'Cafe'))} AS project_name, {_pick('id', ('1 Pine  St 94110', '2 Pine St', '', '94110'))} AS project_address, {_pick('id', ('', 'Fire Co'))} AS dba_name_associated_with_this_permit_holder,
  concat('Holder ', CAST(id % 10 AS STRING)) AS permit_holder, concat(CAST(id % 60 AS STRING), ' Ash St') AS permit_address, {_pick('id', ('', 'Cart'))} AS dbaname, concat('Biz ', CAST(id % 25 AS STRING)) AS businessname,
  {_pick('id', ('', 'Market', 'Polk'))} AS vendinglocationstreet, {_pick('id', ('5th', '', '6th', '7th'))} AS vendinglocationcrossstreet, concat(CAST(id % 70 AS STRING), ' Bay St') AS streetaddress,
  {_day(30)} AS dba_start_date, {_day(31)} AS filed_date, {_day(32)} AS inspection_date, concat('20240', CAST(id % 9 + 1 AS STRING), '1', CAST(id % 10 AS STRING)) AS received, {_day(33)} AS open_date, {_day(34)} AS permit_application_date, {_day(35)} AS submission_created
FROM ({RAW_FIELDS}) r
"""


def _address_key(x: str) -> str:
    """Tokens, cut at a unit word, ordinal, house number and suffix, for the words that FILINGS can hold."""
    t = f"list_filter(string_split_regex(translate(upper({x}), ',.', ''), '\\s+'), lambda t: t <> '')"
    cut = f"(CASE WHEN coalesce(list_min(list_transform(['APT', 'UNIT', 'STE', 'SUITE', 'RM', 'FL', '#'], lambda u: nullif(list_position({t}, u), 0))), 0) > 1 THEN ({t})[:list_min(list_transform(['APT', 'UNIT', 'STE', 'SUITE', 'RM', 'FL', '#'], lambda u: nullif(list_position({t}, u), 0))) - 1] ELSE {t} END)"
    joined = f"array_to_string({cut}, ' ')"
    one = f"regexp_replace({joined}, '^([0-9]+)-[0-9]+', '\\1')"
    two = f"regexp_replace({one}, ' FIRST( |$)', ' 1ST\\1')"
    return f"regexp_replace(regexp_replace({two}, ' STREET$', ' ST'), ' (AVENUE|AV)$', ' AVE')"


def _name_key(x: str) -> str:
    plain = f"trim(regexp_replace(regexp_replace(translate(upper({x}), '''', ''), '[^A-Z0-9]', ' ', 'g'), ' +', ' ', 'g'))"
    ends = "LLC|INC|CORP|CORPORATION|CO|COMPANY|LP|LLP|LTD"
    bare = f"regexp_replace({plain}, '(^| )({ends})( ({ends}))*$', '')"
    return f"array_to_string(list_transform(string_split({bare}, ' '), lambda t: CASE WHEN strlen(t) > 3 AND t LIKE '%S' AND t NOT LIKE '%SS' THEN t[:-2] ELSE t END), ' ')"


_BASE = f"""
f AS ({FILINGS}),
s AS (SELECT f.*, {_address_key('address')} AS ak0, {_name_key('name')} AS nk0 FROM f),
st AS (SELECT *, CASE WHEN strlen(ak0) >= 5 THEN ak0 ELSE '' END AS ak, CASE WHEN strlen(nk0) >= 4 THEN nk0 ELSE '' END AS nk FROM s),
cand AS (SELECT *, external_id AS id FROM st WHERE NOT seen AND score >= 1 AND date >= '2000-08-01' AND date <= '2001-08-01' AND (score >= 2 OR source <> 'business')),
hist AS (SELECT DISTINCT source, name, date, ak, nk FROM st WHERE address <> '' AND score >= 2)
"""


def _hits(key: str, most: int) -> str:
    return f"""(SELECT source, id, coalesce(string_agg(hs || ': ' || hn || ' (' || hd || ')', ', ' ORDER BY hd DESC, hs, hn), '') AS hits, count(hs) AS n FROM (
  SELECT c.source, c.id, h.source AS hs, h.name AS hn, h.date AS hd, row_number() OVER (PARTITION BY c.source, c.id ORDER BY h.date DESC, h.source, h.name) AS r
  FROM cand c LEFT JOIN (SELECT DISTINCT source, name, date, {key} FROM hist WHERE {key} <> '') h ON h.{key} = c.{key} AND h.source <> c.source) WHERE r <= {most} GROUP BY ALL)"""


_INHERIT = """hood AS (SELECT ak, arg_min(neighborhood, {'d': date, 's': source, 'i': external_id}) AS inherited FROM st WHERE address <> '' AND neighborhood <> '' AND ak <> '' GROUP BY ak)"""
_ENTRIES = f"""
ha AS {_hits('ak', 3)}, hn AS {_hits('nk', 2)}, {_INHERIT},
ent AS (SELECT c.source, c.id, c.name, c.address, c.date, coalesce(nullif(c.neighborhood, ''), inherited, '') AS neighborhood, CAST(c.score + CASE WHEN ha.n > 0 THEN 2 ELSE 0 END + CASE WHEN hn.n > 0 THEN 1 ELSE 0 END AS INTEGER) AS score,
  CAST(1 + CAST(ha.n > 0 AS INTEGER) + CAST(hn.n > 0 AS INTEGER) AS INTEGER) AS n_reasons, 'filed' || CASE WHEN ha.n > 0 THEN '; corroborated by ' || ha.hits ELSE '' END || CASE WHEN hn.n > 0 THEN '; name also in ' || hn.hits ELSE '' END AS reasons, c.ak, c.nk FROM cand c JOIN ha USING (source, id) JOIN hn USING (source, id) LEFT JOIN hood USING (ak))
"""
_RANK = "list_position(['abc', 'health', 'business', 'tables_chairs', 'entertainment', 'mobile_food', 'vending', 'planning', 'fire', 'permit', 'electrical', 'plumbing'], source)"


def _venues(entries: str) -> str:
    """Entries numbered in the digest's order, venue keys by one anchor per name, and a row per venue."""
    return f"""
num AS (SELECT *, row_number() OVER (ORDER BY date DESC, source, id) AS o FROM {entries}),
anc AS (SELECT nk, arg_min(ak, o) AS anchor FROM num WHERE nk <> '' AND ak <> '' GROUP BY nk),
asg AS (SELECT num.*, CASE WHEN ak <> '' THEN 'A:' || ak WHEN anchor IS NOT NULL THEN 'A:' || anchor WHEN nk <> '' THEN 'N:' || nk ELSE 'I:' || source || ':' || id END AS venue_key FROM num LEFT JOIN anc USING (nk)),
mem AS (SELECT *, row_number() OVER (PARTITION BY venue_key ORDER BY date DESC, score DESC, o) AS p FROM asg),
ven0 AS (SELECT venue_key, max(score) AS score, max(date) AS date, count(*) AS n_entries, arg_min(id, p) AS first_id, arg_min(name, {{'r': {_RANK}, 's': -score, 'p': p}}) FILTER (name <> '') AS nm,
  arg_min(address, {{'r': {_RANK}, 's': -score, 'p': p}}) FILTER (name <> '') AS ad, arg_min(address, p) FILTER (address <> '') AS ad2, coalesce(arg_min(neighborhood, p) FILTER (neighborhood <> ''), '') AS neighborhood,
  coalesce(min(o) FILTER (ak <> ''), min(o)) AS root FROM mem GROUP BY venue_key),
ven AS (SELECT *, coalesce(nullif(ad, ''), ad2, '') AS address, coalesce(nm, coalesce(nullif(ad, ''), ad2, '(unnamed)')) AS name FROM ven0)
"""


_DISPLAY = f"WITH {_BASE}, {_ENTRIES}, {_venues('ent')}, shown AS (SELECT *, CASE WHEN score >= 4 THEN 'strong' ELSE 'watch' END AS bucket FROM ven WHERE score >= 2)"


def _words(col: str, words: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"list_filter([{listed}], lambda w: contains({col}, w))"


_PERMIT = (
    "restaurant", "cafe", "coffee", "bakery", "boba", "tea shop", "ice cream", "gelato", "taqueria", "pizzeria", "pizza", "ramen", "sushi", "izakaya", "poke", "deli", "bistro", "brewery", "taproom", "brewpub", "winery",
    "tasting room", "food hall", "juice", "grocery", "butcher", "retail", "storefront", "salon", "gym",
)
_PLANNING = (*_PERMIT, "food service", "takeout", "take-out", "outdoor dining", "nighttime entertainment", "formula retail")
_TRADE = ("restaurant", "food service", "cafe", "cafeteria", "bakery", "commercial kitchen", "espresso", "brewery", "taproom", "pizza oven", "walk-in cooler", "walk-in freezer", "type 1 hood")
#: A bar that follows none of the compounds' words: those are taken out first.
_BAR = "CASE WHEN regexp_matches(regexp_replace(d, '(^|[^a-z0-9])(wet|grab|towel|handle)[^a-z0-9]+bar($|[^a-z0-9])', ' ', 'g'), '(^|[^a-z0-9])bar($|[^a-z0-9])') THEN ['bar'] ELSE CAST([] AS VARCHAR[]) END"
_RAW = f"r AS ({RAW_FIELDS}), x AS (SELECT *, lower(trim(description)) AS d FROM r)"


def _score(*parts: tuple[str, int, str], source: str = "x") -> str:
    total = " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n, _ in parts)
    why = ", ".join(f"CASE WHEN {c} THEN {t} END" for c, _, t in parts)
    return f"SELECT id, CAST({total} AS INTEGER) AS score, array_to_string(list_filter([{why}], lambda z: z IS NOT NULL), '; ') AS reasons FROM {source}"


def _number(col: str) -> str:
    return f"CASE WHEN regexp_matches({col}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST({col} AS DOUBLE) END"


def _trade(words: tuple[str, ...], col: str) -> str:
    n = _number(col)
    return f"WITH {_RAW}, y AS (SELECT *, list_concat({_words('d', words)}, {_BAR}) AS h FROM x) " + _score(
        ("len(h) > 0", 2, "'keyword: ' || array_to_string(h, ', ')"), ("len(h) = 0 AND contains(d, 'kitchen')", 1, "'keyword: kitchen'"), (f"coalesce({n} > 50000, false)", 1, f"'valuation $' || printf('%.0f', {n})"), source="y"
    )


_COST = _number("estimated_cost")
_FOOD = "(self_reported_naics_code LIKE '722%' OR regexp_matches(upper(lic_code_description), 'RESTAURANT|FOOD|CAFE|CATERING|BAR'))"
_FIRE = "(contains(k, 'place of assembly') AND NOT contains(k, 'temporary') AND NOT contains(k, 'special') OR contains(k, 'commercial cooking') OR contains(k, 'hood'))"

SQL = {
    "addr_norm": f"WITH f AS ({FILINGS}) SELECT source, external_id, {_address_key('address')} AS address_key FROM f",
    "name_match_key": f"WITH f AS ({FILINGS}) SELECT source, external_id, {_name_key('name')} AS name_key FROM f",
    "norm_date": f"WITH f AS ({FILINGS}) SELECT source, external_id, date AS day FROM f",
    "address_without_zip": f"WITH f AS ({FILINGS}) SELECT source, external_id, trim(regexp_replace(regexp_replace(address || CASE WHEN k % 2 = 0 THEN '' ELSE ' 9411' END, '^ +| +$', '', 'g'), ' +', ' ', 'g')) AS street FROM f",
    "score_business": f"WITH {_RAW} " + _score(
        (_FOOD, 2, "'food service (lic: ' || lic_code_description || ', NAICS: ' || self_reported_naics_code || ')'"), (f"NOT {_FOOD} AND self_reported_naics_code LIKE '3121%'", 2, "'beverage producer (NAICS: ' || self_reported_naics_code || ')'"),
        (f"NOT {_FOOD} AND (self_reported_naics_code LIKE '44%' OR self_reported_naics_code LIKE '45%')", 2, "'retail (NAICS: ' || self_reported_naics_code || ')'"),
        ("dba_name <> '' AND lower(dba_name) <> lower(ownership_name)", 1, """'new DBA "' || dba_name || '" differs from owner "' || ownership_name || '"'"""),
    ),
    "score_permit": f"WITH {_RAW}, y AS (SELECT *, list_concat({_words('d', _PERMIT)}, {_BAR}) AS h FROM x) " + _score(
        ("len(h) > 0", 2, "'keyword: ' || array_to_string(h, ', ')"), ("contains(d, 'change of use')", 1, "'change of use'"), ("contains(d, 'tenant improvement')", 1, "'tenant improvement'"),
        ("d LIKE 'new %' OR d = 'new' OR contains(d, 'new business')", 1, "'new business'"), ("regexp_matches(lower(proposed_use), 'restaurant|retail|store')", 1, "'proposed use: ' || proposed_use"),
        (f"coalesce({_COST} > 100000, false)", 1, f"'estimated cost $' || printf('%.0f', {_COST})"), source="y",
    ),
    "score_planning": f"WITH {_RAW}, y AS (SELECT *, list_concat({_words('d', _PLANNING)}, {_BAR}) AS h FROM x) " + _score(("len(h) > 0", 2, "'planning application keyword: ' || array_to_string(h, ', ')"), ("contains(d, 'change of use')", 1, "'change of use'"), source="y"),
    "score_electrical": _trade(_TRADE, "permit_valuation"), "score_plumbing": _trade((*_TRADE, "grease"), "valuation"),
    "score_fire": f"WITH {_RAW}, y AS (SELECT *, lower(permit_type_description) AS k FROM x) " + _score((_FIRE, 3, "'fire permit: ' || k"), source="y"),
    "score_vending": f"WITH {_RAW} " + _score(("true", 2, "'street vending permit'"), ("regexp_matches(lower(whatwillyoubeselling || ' ' || describewhatyouwillsell), 'food|coffee|drink|juice|taco|hot dog|fruit|snack|dessert|ice cream')", 1, "'food vendor'")),
    "score_mobile_food": f"WITH {_RAW} " + _score(("true", 2, "'new mobile food permit'"), ("lower(facilitytype) = 'truck'", 1, "'food truck'")),
    "score_entertainment": f"WITH {_RAW} " + _score(("true", 2, "'new entertainment venue'"), ("license_type <> ''", 1, "'license type: ' || license_type")),
    "score_tables_chairs": f"WITH {_RAW} " + _score(("tables = 1", 3, "'sidewalk tables & chairs registration — outdoor seating'"), ("tables <> 1 AND display = 1", 2, "'sidewalk merchandise display registration'"), ("tables <> 1 AND display <> 1", 2, "'Shared Spaces sidewalk registration'")),
    "score_license": """WITH p AS (SELECT p_partkey AS id, p_size AS t, ['ORI', 'PER', 'PRM', 'PER/PRM', '', 'XXX'][p_partkey % 6 + 1] AS a, kind FROM part, (VALUES ('application'), ('issued')) AS v(kind)),
c AS (SELECT *, CASE WHEN t IN (41, 47, 75) THEN 'restaurant' WHEN t IN (40, 42, 48, 61) THEN 'bar' WHEN t IN (20, 21) THEN 'off-sale shop' END AS label FROM p)
SELECT id, kind, CAST(CASE WHEN label IS NULL THEN 0 ELSE greatest(CASE WHEN label = 'off-sale shop' THEN 2 ELSE 3 END + CAST(kind = 'issued' AS INTEGER) - CAST(a = 'PER' AS INTEGER), 0) END AS INTEGER) AS score,
CASE WHEN label IS NULL THEN '' ELSE 'liquor license ' || kind || ': type ' || t || ' (' || label || ')' || CASE WHEN contains(a, 'PRM') THEN ', premises transfer' WHEN a = 'ORI' THEN ', new license' WHEN a = 'PER' THEN ', ownership transfer at existing premises' ELSE '' END END AS reasons FROM c""",
    "first_event_per_key": "SELECT event_id AS seq, 'P' || user_id AS permit, strftime(ts, '%Y-%m-%d') AS date, user_id % 7 <> 0 AND row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d'), event_id) = 1 AS first FROM events",
    "watermark": f"WITH f AS ({FILINGS}) SELECT source, least(greatest(max(date), '1999-01-01'), '2001-06-30') AS watermark, '1999-01-01' AS at_start FROM f GROUP BY source",
    "report_days": """WITH b AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS e, CASE WHEN o_orderkey % 2 <> 0 THEN CAST(o_orderdate AS DATE) - CAST(o_orderkey % 41 AS INTEGER) END AS w, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) - CAST(o_orderkey % 7 AS INTEGER) END AS s FROM orders)
SELECT id, strftime(unnest(generate_series(greatest(coalesce(s, w + 1, e - 14), e - 30), e, INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM b""",
    "upsert_merge": f"""WITH f AS ({FILINGS})
SELECT source, external_id, name || CASE WHEN k % 9 = 0 THEN ' LAST' WHEN k % 3 = 0 THEN ' NEW' ELSE '' END AS name, CASE WHEN k % 4 = 1 THEN '2001-07-15' ELSE date END AS date, date AS first_seen,
CAST(CASE WHEN k % 9 = 0 THEN (k + 2) % 6 WHEN k % 3 = 0 THEN (k + 1) % 6 ELSE score END AS INTEGER) AS score, CASE WHEN k % 4 = 1 THEN false ELSE seen END AS seen FROM f WHERE k % 4 <> 1 OR k % 3 = 0
UNION ALL SELECT source, 'new' || external_id, name, date, date, score, seen FROM f WHERE k % 10 = 0""",
    "snapshot_diff": f"WITH f AS ({FILINGS}) SELECT source, external_id, name FROM f WHERE k % 4 = 1",
    "mark_seen": f"WITH f AS ({FILINGS}) SELECT source, external_id, seen OR score >= 4 AS seen FROM f",
    "archive_stale": f"WITH f AS ({FILINGS}) SELECT source, external_id, seen OR (date < '2000-08-01' AND score >= 2) AS seen FROM f",
    "legacy_migrate": f"""WITH f AS ({FILINGS}), h AS (SELECT *, k % 24 = 0 AS have FROM f)
SELECT source, external_id, CASE WHEN have OR source = 'permit' THEN name WHEN k % 5 = 0 THEN 'Owner ' || external_id ELSE name END AS name, address, date, date AS first_seen, score, CASE WHEN have THEN 'filed' WHEN source = 'business' THEN 'a; b' ELSE '' END AS reasons, seen FROM h WHERE have OR source IN ('business', 'permit')""",
    "digest_candidates": f"WITH {_BASE} SELECT source, id, name, address, date, neighborhood, score, CASE source WHEN 'abc' THEN 'https://www.abc.ca.gov/licensing/license-lookup/single-license/?RPTTYPE=12&LICENSE=' || id WHEN 'permit' THEN 'https://dbiweb02.sfgov.org/dbipts/default.aspx?page=Permit&PermitNumber=' || id WHEN 'planning' THEN 'https://sfplanninggis.org/pim?search=' || id ELSE '' END AS url FROM cand",
    "corroborate_address": f"WITH {_BASE} SELECT source, id, hits FROM {_hits('ak', 3)}",
    "corroborate_name": f"WITH {_BASE} SELECT source, id, hits FROM {_hits('nk', 2)}",
    "inherit_neighborhood": f"WITH {_BASE}, {_INHERIT} SELECT source, id, coalesce(nullif(neighborhood, ''), inherited, '') AS neighborhood FROM cand LEFT JOIN hood USING (ak)",
    "corroborated_scores": f"WITH {_BASE}, {_ENTRIES} SELECT source, id, score, n_reasons, reasons FROM ent",
    "neighborhood_filter": f"""WITH {_BASE}, {_INHERIT} SELECT 'stored' AS filter, source, external_id AS id, neighborhood FROM st WHERE NOT seen AND score >= 1 AND date >= '2000-08-01' AND date <= '2001-08-01' AND neighborhood ILIKE '%t_on_1%'
UNION ALL SELECT 'entries', source, id, coalesce(nullif(neighborhood, ''), inherited, '') FROM cand LEFT JOIN hood USING (ak) WHERE contains(lower(coalesce(nullif(neighborhood, ''), inherited, '')), 'tion_2')""",
    "venue_assign": f"WITH {_BASE}, {_venues('cand')} SELECT source, id, venue_key FROM asg",
    "venue_summary": f"WITH {_BASE}, {_venues('cand')} SELECT venue_key, name, address, neighborhood, score, date, CAST(n_entries AS INTEGER) AS n_entries, first_id FROM ven",
    "venue_history": f"""{_DISPLAY}, vk AS (SELECT venue_key, CASE WHEN strlen({_address_key('address')}) >= 5 THEN {_address_key('address')} ELSE '' END AS ak FROM shown),
h10 AS (SELECT * FROM (SELECT venue_key, h.source, h.name, h.date, row_number() OVER (PARTITION BY venue_key ORDER BY h.date DESC, h.source, h.name) AS r FROM vk JOIN (SELECT DISTINCT source, name, date, ak FROM hist) h USING (ak) WHERE ak <> '') WHERE r <= 10),
h5 AS (SELECT *, row_number() OVER (PARTITION BY venue_key ORDER BY r) AS q FROM h10 WHERE NOT EXISTS (SELECT 1 FROM asg m WHERE m.venue_key = h10.venue_key AND m.source = h10.source AND m.name = h10.name AND m.date = h10.date))
SELECT venue_key, coalesce(string_agg(source || ': ' || h5.name || ' (' || h5.date || ')', ', ' ORDER BY r) FILTER (q <= 5), '') AS earlier FROM vk LEFT JOIN h5 USING (venue_key) GROUP BY venue_key""",
    "digest_order": f"""{_DISPLAY}, ranked AS (SELECT *, max({{'s': score, 'd': date}}) OVER (PARTITION BY bucket, neighborhood) AS top, row_number() OVER (PARTITION BY bucket, neighborhood ORDER BY score DESC, date DESC, root) AS venue_rank FROM shown)
SELECT bucket, CASE bucket WHEN 'strong' THEN 0 ELSE 1 END AS bucket_rank, top.s AS hood_score, top.d AS hood_date, CAST(venue_rank AS INTEGER) AS venue_rank, CASE WHEN v.neighborhood = '' THEN 'Unknown neighborhood' ELSE v.neighborhood END AS neighborhood_shown, v.name AS venue_name, v.address AS venue_address, v.score AS venue_score, v.date AS venue_date,
CAST(p AS INTEGER) AS position, m.source, m.id, m.name, m.date, m.score FROM ranked v JOIN mem m USING (venue_key)""",
    "bucket_counts": f"WITH f AS ({FILINGS}) SELECT CASE WHEN score >= 4 THEN 'strong' WHEN score >= 2 THEN 'watch' ELSE 'low' END AS bucket, CAST({_RANK} - 1 AS INTEGER) AS rank, count(*) AS n, CAST(sum(CASE WHEN seen THEN 1 ELSE 0 END) AS BIGINT) AS n_seen FROM f GROUP BY ALL",
    "strip_tags": r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*(>|\z)', '', 'g'), '>', ''), '&amp;', '&'), '&#038;', '&'), '&#8217;', ''''), '&#39;', ''''), '&quot;', '" + '"' + r"'), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g')) AS text FROM pages",
    "parse_report": "SELECT CAST(s_suppkey AS VARCHAR) AS license_number, 'ACT' AS status, [41, 47, 20, 0, 99][s_suppkey % 5 + 1] AS license_type, 'ORI' AS action, CASE WHEN s_suppkey % 3 = 0 THEN 'Caf&e ' || s_suppkey ELSE '' END AS dba, s_name || ' & Sons' AS owner, s_suppkey || ' Main St' AS street, 'Town' AS city, '94100' AS zip FROM supplier WHERE s_suppkey % 4 <> 0",
    "snippet": r"""WITH c AS (SELECT conv_id, turn, conv_id % 4 AS k, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN k = 2 OR t = '' OR t IS NULL THEN NULL WHEN length(t) <= 120 THEN t ELSE rtrim(t[:117]) || '...' END AS snippet FROM c""",
}

_STREET = "array_to_string(list_filter([street_number, street_name, street_suffix], lambda x: x <> ''), ' ')"
#: By feed: id, name, address, day, neighborhood, least score.
_FEEDS = {
    "business": ("uniqueid", "coalesce(nullif(dba_name, ''), ownership_name)", "full_business_address", "dba_start_date[:10]", "neighborhoods_analysis_boundaries", 0),
    "permit": ("permit_number", "'Permit ' || permit_number", f"{_STREET} || CASE WHEN unit = '' THEN '' ELSE ', unit ' || unit END", "filed_date[:10]", "neighborhoods_analysis_boundaries", 0),
    "entertainment": ("permit_number", "dba_name", "street_address", "'2024-12-31'", "analysis_neighborhood", 0),
    "health": ("permit_number || '-' || inspection_date", "dba", "street_address", "inspection_date[:10]", "analysis_neighborhood", 1),
    "mobile_food": ("objectid", "applicant", "address", "received[:4] || '-' || received[5:6] || '-' || received[7:8]", "''", 0),
    "planning": ("record_id", "coalesce(nullif(project_name, ''), record_id)", "CASE project_address WHEN '1 Pine  St 94110' THEN '1 Pine St' WHEN '94110' THEN '' ELSE project_address END", "open_date[:10]", "''", 2),
    "fire": ("permit_number", "coalesce(nullif(dba_name_associated_with_this_permit_holder, ''), permit_holder)", "permit_address", "permit_application_date[:10]", "''", 2),
    "vending": ("vid", "dbaname", "vendinglocationstreet || CASE WHEN vendinglocationstreet = '' OR vendinglocationcrossstreet = '' THEN '' ELSE ' & ' || vendinglocationcrossstreet END", "'2024-12-31'", "analysis_neighborhood", 0),
    "tables_chairs": ("vid", "coalesce(nullif(dbaname, ''), businessname)", "streetaddress", "submission_created[:10]", "analysis_neighborhood", 0),
    "electrical": ("permit_number", "'Permit ' || permit_number", _STREET, "filed_date[:10]", "neighborhoods_analysis_boundaries", 2),
    "plumbing": ("permit_number", "'Permit ' || permit_number", _STREET, "filed_date[:10]", "neighborhoods_analysis_boundaries", 2),
}
_FIRST = """SELECT id, CAST(CASE WHEN n = 1 THEN 3 ELSE 0 END AS INTEGER) AS score, CASE WHEN n = 1 THEN 'first health inspection since 2024' ELSE '' END AS reasons FROM (SELECT id, row_number() OVER (PARTITION BY permit_number ORDER BY inspection_date, id) AS n FROM w)"""


def _feed(key: str) -> str:
    own, name, address, day, hood, least = _FEEDS[key]
    score = _FIRST if key == "health" else SQL[f"score_{key}"]
    return f"""SELECT '{key}' AS source, {own} AS external_id, {name} AS name, {address} AS address, {day} AS date, {hood} AS neighborhood, score, reasons, {'true' if key == 'health' else 'false'} AS seen, record_id AS raw_record
FROM w JOIN ({score}) AS s USING (id) WHERE trim({own}, '-') <> '' AND score >= {least}"""


SQL["feed_signals"] = f"WITH w AS ({FEED_ROWS}) " + " UNION ALL ".join(map(_feed, _FEEDS))
