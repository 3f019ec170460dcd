"""Row-level normalisers as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Street words of the address key, in order.
STREET_WORDS = {
    "STREET": "ST", "DRIVE": "DR", "ROAD": "RD", "AVENUE": "AVE", "LANE": "LN", "TERRACE": "TER", "CIRCLE": "CIR", "COURT": "CT",
    "PLACE": "PL", "BOULEVARD": "BLVD", "PARKWAY": "PKWY", "SQUARE": "SQ", "TRAIL": "TRL", "EXTENSION": "EXT", "HIGHWAY": "HWY",
    "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W",
}
#: Street words of duplicate linking, in order.
LINK_WORDS = {
    "street": "st", "avenue": "ave", "drive": "dr", "road": "rd", "court": "ct", "lane": "ln", "place": "pl", "boulevard": "blvd",
    "north": "n", "south": "s", "east": "e", "west": "w",
}
#: How the sites write units and details.
UNIT = r"(?i)\b(?:UNIT|APT|#)\s*([A-Z0-9-]+)\b"
#: Phrases of an empty result page.
EMPTY_PAGE = ("nothing found", "no results found", "no results were found", "we cant find what youre looking for", "no listings found", "no matching results", "content not found", "page not found")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def group(c: Column, pattern: str, n: int = 1) -> Column:
    """A regular expression's group, null where it does not match."""
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def clean_int(c: Column) -> Column:
    return F.regexp_replace(group(c, r"([\d,]+)"), ",", "").try_cast("bigint")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shortened(c: Column, words: dict[str, str]) -> Column:
    """c with its whole words in their short forms, in one pass over them; no short form may be a word of its own."""
    short = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.array_join(F.transform(F.split(c, r"\b"), lambda w: F.coalesce(F.try_element_at(short, w), w)), "")


def bathrooms(c: Column) -> Column:
    """A plain number, else full baths and half of the half baths; null if there are none."""
    return once(F.trim(c), lambda x: read_bathrooms(x, baths_sum(x)))


def baths_sum(x: Column) -> Column:
    part = lambda word: F.coalesce(F.regexp_extract(x, rf"(\d+)\s*{word}", 1).try_cast("double"), F.lit(0.0))
    return F.when(x.isNotNull(), part("full") + 0.5 * part("half"))


def read_bathrooms(x: Column, total: Column) -> Column:
    """bathrooms() of a trimmed text and its baths_sum(); each is used more than once, so it should be a column."""
    return F.when(x.rlike(r"^\d+(\.\d+)?$"), x.try_cast("double")).otherwise(F.nullif(total, F.lit(0.0)))


def bathrooms_raw(c: Column) -> Column:
    """The raw text where it is in no known form."""
    x = blank_to_null(c)
    return F.when(~x.rlike(r"^\d+(\.\d+)?$|\d+\s*full|\d+\s*half"), x)


def labelled(c: Column, name: str, value: str) -> Column:
    return F.trim(group(c, rf"{name}:\s*({value})"))


def baths_text(c: Column) -> Column:
    return labelled(c, r"#\s*Baths", "[^;]+")


def parse_description(c: Column) -> dict[str, Column]:
    return {
        "property_type": labelled(c, "Property Type", "[^;]+"),
        "mortgage_ref": labelled(c, "Mortgage Ref", "[^;]+"),
        "lot_size_raw": labelled(c, "Lot Size", "[^;]+"),
        "sqft": F.replace(labelled(c, "Square Feet", r"[\d,]+"), F.lit(","), F.lit("")).try_cast("bigint"),
        "bedrooms": labelled(c, r"#\s*Bedrooms", r"\d+").try_cast("bigint"),
        "bathrooms": bathrooms(baths_text(c)),
        "year_built": labelled(c, "Year Built", r"\d{4}").try_cast("bigint"),
    }


def property_details(columns: dict[str, Column], description: Column) -> dict[str, Column]:
    """Explicit columns win; a blank one falls back to the description; one that cannot be read gives null."""
    parsed = parse_description(description)
    read = {"sqft": clean_int, "bedrooms": clean_int, "year_built": clean_int, "bathrooms": bathrooms}
    out = {}
    for name, found in parsed.items():
        raw = blank_to_null(columns[name]) if name in columns else F.lit(None).cast("string")
        out[name] = F.when(raw.isNotNull(), read.get(name, lambda x: x)(raw)).otherwise(found)
    return out


def clean_lot_size(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?i)\s+lot\s*$", ""))


def metadata_ok(c: Column) -> Column:
    """Whether a non-blank metadata text is JSON; null for blank."""
    x = blank_to_null(c)
    return F.when(x.isNotNull(), F.try_parse_json(x).isNotNull())


def normalize_street(c: Column) -> Column:
    x = F.regexp_replace(F.trim(F.upper(F.regexp_replace(F.split(c, " a/k/a ")[0], "[.,]", ""))), r"\s+", " ")
    x = shortened(x, STREET_WORDS)
    return F.coalesce(F.regexp_replace(F.trim(F.regexp_replace(x, UNIT, "")), r"\s+", " "), F.lit(""))


def address_key(street: Column, city_state: Column) -> Column:
    """struct(zip, street, unit); null where zip or street is missing."""
    zip5 = F.regexp_extract(F.coalesce(city_state, F.lit("")), r"(\d{5})(?:-\d{4})?\s*$", 1)
    key = F.struct(zip5.alias("zip"), normalize_street(street).alias("street"), F.upper(F.regexp_extract(F.coalesce(street, F.lit("")), UNIT, 1)).alias("unit"))
    return once(key, lambda x: F.when((x["zip"] != "") & (x["street"] != ""), x))


def coord_key(lat: Column, lon: Column) -> Column:
    return F.struct(F.bround(lat, 6).alias("lat"), F.bround(lon, 6).alias("lon"))


def house_number(address: Column) -> Column:
    return group(F.lower(F.trim(address)), r"^(\d+[a-z]?)\s+")


def house_street(address: Column) -> Column:
    x = F.regexp_extract(F.lower(F.trim(address)), r"^\d+[a-z]?\s+(.*)", 1)
    x = F.regexp_replace(F.split(x, ",")[0], r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(shortened(x, LINK_WORDS), r"\s+", " "))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371000.0 * F.asin(F.sqrt(a))


def extract_listing_id(url: Column, address: Column, slug_hosts: tuple[str, ...] = (), path_hosts: tuple[str, ...] = (), fragment_hosts: tuple[str, ...] = (), auction_hosts: tuple[str, ...] = ()) -> Column:
    """A stable key from a listing's URL, by rules of its host; in general the id parameter, else the URL."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    part = lambda p: F.try_parse_url(url, F.lit(p))
    at = lambda hosts: F.exists(F.array(*map(F.lit, hosts)), lambda h: F.contains(host, h)) if hosts else F.lit(False)
    last = group(part("PATH"), r"/(\d+)/*$")
    said = F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("id")), group(url, r"^[^?#]*\?(?:[^#]*&)?id=([^&#]+)"))
    query_id = F.coalesce(F.try_url_decode(said), said)
    return (
        F.when(at(path_hosts) & last.isNotNull(), last)
        .when(at(slug_hosts), F.coalesce(slugify(blank_to_null(address)), url))
        .when(at(fragment_hosts) & (F.coalesce(part("REF"), F.lit("")) != ""), part("REF"))
        .when(at(auction_hosts) & query_id.isNull(), F.coalesce(group(part("PATH"), r"^/auction/(\d+)/"), url))
        .otherwise(F.coalesce(query_id, url))
    )


def labels_to_map(c: Column) -> Column:
    """'Label: value; Label: value' as a map of snake-case labels; the last of a repeated label counts."""
    entry = lambda p: F.struct(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.substring_index(p, ": ", 1))), "[^a-z0-9]+", "_"), "^_+|_+$", "").alias("key"), F.trim(F.substr(p, F.instr(p, ": ") + 2)).alias("value"))
    found = F.filter(F.transform(F.filter(F.split(c, "; "), lambda p: F.contains(p, F.lit(": "))), entry), lambda e: (e["key"] != "") & (e["value"] != ""))
    last = F.filter(found, lambda e, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def route_labels(m: Column) -> dict[str, Column]:
    """Known labels of a map in columns, the others joined as 'label: value; ...'."""
    first = lambda *names: F.coalesce(*(F.try_element_at(m, F.lit(n)) for n in names))
    used = ("County", "Property Type", "Lot Size", "Square Feet", "# Bedrooms", "# Baths", "Year Built")
    rest = F.filter(F.map_entries(m), lambda e: ~e["key"].isin(*used))
    return {
        "county": F.coalesce(first("County"), F.lit("")),
        "property_type": first("Property Type"),
        "lot_size": clean_lot_size(first("Lot Size")),
        "sqft": clean_int(first("Square Feet", "Sq Ft", "Sq. Ft.")),
        "bedrooms": clean_int(first("# Bedrooms", "Bedrooms")),
        "bathrooms": first("# Baths", "Baths"),
        "year_built": clean_int(first("Year Built")),
        "extra_fields": F.array_join(F.transform(rest, lambda e: F.concat(F.trim(F.regexp_replace(e["key"], "^#+", "")), F.lit(": "), e["value"])), "; "),
    }


#: The states that the sources cover, and words that end a street.
STATES = "MA|NH|RI|VT|ME|CT"
STREET_ENDS = "Road|Rd|Street|St|Avenue|Ave|Drive|Dr|Lane|Ln|Way|Court|Ct|Boulevard|Blvd|Place|Pl|Circle|Cir|Terrace|Ter|Highway|Hwy|Parkway|Pkwy|Trail|Trl|Square|Sq|Path|Row|Extension|Ext"


def split_address(c: Column, form: str = "commas") -> dict[str, Column]:
    """street, city, addr_state and zip of a source's address text; what does not fit the form is all street.

    Forms: commas 'street, city, ST zip'; gap 'street   city, county, ST zip'; title 'street, unit, city, ST zip (note)';
    parts 'street, city, ST' of any number of commas, the first three counting; blob the same from the end, one comma
    leaving the city out; scan a street found by its last word in running text, after 'City, ST'.
    """
    x = F.trim(c)
    if form == "scan":
        street = rf"(?i)(\d+[\w-]*(?:\s+[A-Za-z][\w'.-]*){{0,5}}?\s+(?:{STREET_ENDS})\b\.?)"
        town = rf"([A-Za-z .'’-]+),\s*({STATES})\b"
        return {"street": F.coalesce(group(x, street), x), "city": F.trim(group(x, town)), "addr_state": group(x, town, 2), "zip": group(x, rf"\b(?:{STATES})\s+(\d{{5}})\b")}
    if form in ("parts", "blob"):
        parts = F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: p != "")
        n = F.size(parts)
        at = lambda i: F.get(parts, i)
        if form == "parts":
            street, city, rest = F.when(n >= 2, at(F.lit(0))).otherwise(x), F.when(n >= 2, at(F.lit(1))), F.when(n >= 3, at(F.lit(2)))
        else:
            street = F.when(n >= 3, F.array_join(F.slice(parts, 1, F.greatest(n - 2, F.lit(1))), ", ")).when(n == 2, at(F.lit(0))).otherwise(x)
            city, rest = F.when(n >= 3, at(n - 2)), F.when(n >= 2, at(n - 1))
        return {"street": street, "city": city, "addr_state": F.coalesce(group(rest, r"^([A-Z]{2})\b"), rest), "zip": group(rest, r"(\d{5})$")}
    pattern, places = {
        "commas": (r"^(.*?),\s*([^,]+),\s*([A-Z]{2})\s*(\d{5})?(?:-\d{4})?$", (1, 2, 3, 4)),
        "gap": (r"^(.+?)\s{2,}([^,]+),\s*(?:.*?,\s*)?(?:([A-Z]{2})\s*)?(\d{5})?\s*$", (1, 2, 3, 4)),
        "title": (rf"^(.+?),\s*([^,]+?),\s*({STATES})\s+(\d{{5}})\s*(?:\([^)]*\))?\s*$", (1, 2, 3, 4)),
    }[form]
    part = lambda i: F.trim(group(x, pattern, i))
    return {"street": F.when(x.rlike(pattern), part(places[0])).otherwise(x), **{k: part(i) for k, i in zip(("city", "addr_state", "zip"), places[1:], strict=True)}}


def clean_city(c: Column) -> Column:
    """A city without what follows in brackets."""
    return F.trim(F.regexp_replace(c, r"\s*\([^)]*\)\s*$", ""))


def registry_refs(c: Column) -> dict[str, Column]:
    text = F.regexp_replace(c, r"(?i)^\s*Registry:\s*", "")
    return {
        "county": F.trim(F.regexp_replace(text, r"(?i)\s*Book\s*/\s*Page:.*$", "")),
        "book_page": F.trim(F.regexp_extract(text, r"(?i)\s*Book\s*/\s*Page:\s*(.*)$", 1)),
        "document": group(c, r"(?i)Doc(?:ument)?\s*#\s*:?\s*([0-9-]+)"),
        "certificate": group(c, r"(?i)Certificate\s*#?\s*:?\s*([0-9-]+)"),
        "deposit": group(c, r"(?i)Deposit:?\s*\$?([\d,.]+)"),
    }


def clean_url(c: Column) -> Column:
    """Every byte that a URL may not hold percent-encoded, in UTF-8; what is encoded already stays, a lone % becomes %25."""
    x = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    allowed = r"[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]"
    runs = F.regexp_extract_all(x, F.lit(rf"(?s){allowed}+|.[\x{{200D}}]*"), F.lit(0))
    code = lambda r: F.regexp_replace(F.hex(F.encode(r, "UTF-8")), "(..)", "%$1")
    quoted = F.array_join(F.transform(runs, lambda r: F.when(r.rlike(rf"^{allowed}"), r).otherwise(code(r))), "")
    return F.when(x.rlike(rf"^{allowed}*$"), x).otherwise(quoted)


def spec_line(kind: Column, beds: Column, baths: Column, sqft: Column) -> Column:
    """Type, beds, baths and square feet with blanks left out."""
    number = lambda c: F.regexp_replace(F.format_string("%.1f", c.cast("double")), r"\.0$", "")
    return F.concat_ws(" · ", blank_to_null(kind), F.concat(beds.cast("string"), F.lit(" bed")), F.when(baths.isNotNull(), F.concat(number(baths), F.lit(" bath"))), F.when(sqft.isNotNull(), F.concat(F.format_number(sqft, 0), F.lit(" sf"))))


def map_url(base: str, lat: Column, lon: Column) -> Column:
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(F.lit(f"{base}?lat="), F.format_string("%.6f", lat), F.lit("&lon="), F.format_string("%.6f", lon))).otherwise("")


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def state_list(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda s: F.upper(F.trim(s))), lambda s: s != ""))


def geography(response: Column) -> dict[str, Column]:
    """State, county and municipality of a geocoder's JSON answer."""
    at = lambda path: F.coalesce(F.get_json_object(response, f"$.result.geographies{path}"), F.lit(""))
    return {
        "geo_state": at(".States[0].STUSAB"),
        "county": F.regexp_replace(at(".Counties[0].NAME"), r"(?i)\s+County$", ""),
        "municipality": F.regexp_replace(at("['County Subdivisions'][0].NAME"), r"(?i)\s+(town|city|borough|village|plantation)$", ""),
    }


def page_alive(status: Column, html: Column) -> Column:
    """False for 404, 410, and for a fetched page that reads like an empty result; true for all else."""
    x = F.regexp_replace(F.lower(F.coalesce(html, F.lit(""))), "[’‘']|&rsquo;|&lsquo;|&#8217;", "")
    empty = F.lit(False)
    for phrase in EMPTY_PAGE:
        empty = empty | F.contains(x, F.lit(phrase))
    return ~(status.isin(404, 410) | (status.between(200, 399) & empty))


def extraction_cost(text: Column, fixed: int = 400, out: int = 300, price_in: float = 3.0, price_out: float = 15.0) -> Column:
    """Estimated price of extracting fields from a text: a token per four characters and fixed parts, per million tokens."""
    return ((F.floor(F.length(text) / 4) + fixed) * price_in + out * price_out) / 1e6
