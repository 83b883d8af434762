"""SQL counterparts of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from swatchbook.functions.text import CONTEXT_LENGTH, TOKEN_PATTERN
from swatchbook.functions.vectors import CHANNEL_MEAN, CHANNEL_STD, LOGIT_SCALE
from swatchbook.operators.catalog import CLEANED_COLUMNS, MISSING_TEXTS
from swatchbook.plans.queries import BATCH, FAMILIES, PRODUCT_COLUMNS, PROJECTED, RARE_ROWS, TOP_K
from swatchbook.sources.merges import MAX_MERGES

# Catalogue

PRODUCTS = "products AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in PRODUCT_COLUMNS.items()) + " FROM part)"
_MISSING = ", ".join(f"'{t}'" for t in MISSING_TEXTS)
_FAMILIES = ", ".join(f"'{f}'" for f in FAMILIES)


def _nulled(column: str) -> str:
    if column not in CLEANED_COLUMNS:
        return column
    return f"CASE WHEN {column} IN ({_MISSING}) THEN NULL ELSE {column} END AS {column}"


CLEANED = "cleaned AS (SELECT " + ", ".join(_nulled(c) for c in PRODUCT_COLUMNS) + " FROM {source})"


def rare(limit: int = RARE_ROWS) -> str:
    return (
        "rare AS (SELECT DISTINCT product_category FROM (SELECT product_family, product_category, count(*) AS n "
        f"FROM products GROUP BY ALL) WHERE n <= {limit}), "
        "common AS (SELECT * FROM products p WHERE NOT EXISTS "
        "(SELECT 1 FROM rare r WHERE r.product_category = p.product_category))"
    )


_ATTRIBUTE_TYPE = """'[{"attribute_name":"VARCHAR","attribute_values":["VARCHAR"]}]'"""


def parsed(source: str) -> str:
    return (
        f"parsed AS (SELECT product_id, from_json(product_attributes::JSON, {_ATTRIBUTE_TYPE}) AS attrs FROM {source}), "
        "attributes AS (SELECT product_id, a.attribute_name, a.attribute_values FROM "
        "(SELECT product_id, unnest(attrs) AS a FROM parsed))"
    )


FREQUENT = (
    "frequent AS (SELECT * FROM attributes WHERE attribute_name IN "
    "(SELECT attribute_name FROM attributes WHERE attribute_name IS NOT NULL GROUP BY 1 HAVING count(*) >= 50))"
)


def single(source: str) -> str:
    return (
        "single AS (SELECT product_id, attribute_name, attribute_values[1] AS attribute_values "
        f"FROM {source} WHERE attribute_name NOT IN ('Condition', 'Occasion') "
        "AND coalesce(len(attribute_values), -1) <= 1)"
    )


VALUES = (
    "vals AS (SELECT product_id, coalesce(list_sort(list(DISTINCT attribute_values) "
    "FILTER (WHERE attribute_values IS NOT NULL)), []) AS attribute_values FROM single GROUP BY product_id)"
)
FACETS = """facets AS (SELECT product_id, product_family,
  lower(coalesce(product_sub_category, product_category)) AS desc_category,
  product_brand AS desc_brand,
  CASE WHEN product_gender IN ('MEN', 'WOMEN') THEN lower(product_gender) END AS desc_gender,
  lower(product_main_colour) AS desc_color,
  product_image_path, product_short_description FROM cleaned)"""


def facets_with_values() -> str:
    return ", ".join(
        [
            PRODUCTS,
            rare(),
            f"kept AS (SELECT * FROM common WHERE product_family NOT IN ({_FAMILIES}))",
            CLEANED.format(source="kept"),
            parsed("cleaned"),
            FREQUENT,
            single("frequent"),
            VALUES,
            FACETS,
        ]
    )


PHRASE = (
    "lower(CASE WHEN len({x}) = 1 THEN {x}[1] ELSE concat(array_to_string({x}[1:len({x}) - 1], ', '), ' and ', {x}[len({x})]) END)"
)


def slot(prefix: str, column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '' ELSE trim(concat('{prefix} ', lower({column}))) END"


def described() -> str:
    """CTE `described(product_id, description)`."""
    phrase = PHRASE.format(x="attribute_values")
    return (
        facets_with_values()
        + f""", slots AS (SELECT f.product_id,
  coalesce(desc_category, 'None') AS category, coalesce(desc_brand, 'None') AS brand,
  {slot("for", "desc_gender")} AS gender, {slot("color", "desc_color")} AS color_phrase,
  {slot("", "desc_color")} AS color, {slot("", "product_short_description")} AS short,
  CASE WHEN attribute_values IS NULL OR len(attribute_values) = 0 THEN ''
       ELSE trim(concat('with ', {phrase})) END AS attrs
  FROM facets f LEFT JOIN vals v ON f.product_id = v.product_id),
described AS (SELECT product_id, trim(CASE product_id % 3
  WHEN 0 THEN concat('a ', category, ' made by ', brand, ' ', color_phrase, ' ', attrs, ' ', gender, '. ', short)
  WHEN 1 THEN concat('a ', category, ' made by ', brand, ' ', attrs, '; ', color_phrase, ' ', gender, '. ', short)
  ELSE concat(color, ' ', category, ' ', attrs, ' from ', brand, ' ', gender, '. ', short) END) AS description
  FROM slots)"""
    )


_WITH_VALUES = (
    f"WITH {facets_with_values()} SELECT f.*, array_to_string(v.attribute_values, '|') AS attribute_values "
    "FROM facets f LEFT JOIN vals v ON f.product_id = v.product_id"
)

# Text

# White space as Unicode defines it; \s is ASCII in this dialect.
SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def squeezed(column: str) -> str:
    return f"lower(trim(regexp_replace({column}, '{SPACE}+', ' ', 'g')))"


_PATTERN = "(?i)" + TOKEN_PATTERN.replace("'", "''")


def words(source: str, key: str, column: str) -> str:
    """CTE `words(key, words)`."""
    return f"words AS (SELECT {key}, regexp_extract_all({squeezed(column)}, '{_PATTERN}') AS words FROM {source})"


DOC_WORDS = words("documents", "doc_id", "text")


def unescaped(column: str) -> str:
    """Character references that occur in the pages, resolved in one pass."""
    out = f"replace(replace(replace({column}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"')"
    mark = "chr(57344)"
    return f"replace(replace(replace({out}, '&amp;', {mark}), '&amp', {mark}), {mark}, '&')"


FRAMED = (
    DOC_WORDS + ", ids AS (SELECT doc_id, list_transform(words, lambda w: length(w)) AS ids FROM words), "
    "framed AS (SELECT doc_id, len(ids) + 2 AS n_tokens, "
    f"list_concat([1000000], ids, [1000001], list_transform(range(greatest(0, {CONTEXT_LENGTH} - 2 - len(ids))), lambda i: 0))"
    f"[1:{CONTEXT_LENGTH}] AS framed FROM ids)"
)

MERGES = f"""doc_words AS (SELECT doc_id, regexp_extract_all({squeezed("text")}, '{_PATTERN}') AS words FROM documents),
letter_words AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM doc_words)
  WHERE regexp_full_match(word, '[a-z]+') GROUP BY 1),
kinds AS (SELECT * FROM (VALUES (1, 1, 1), (2, 2, 1), (3, 2, 2)) AS t(level, a, b)),
places AS (SELECT level, a, b, word, n, unnest(range(1, length(word) - (a + b) + 2)) AS i
  FROM letter_words, kinds WHERE length(word) >= a + b),
letter_pairs AS (SELECT level, substr(word, i, a) AS l,
  concat(substr(word, i + a, b), CASE WHEN i + a + b - 1 = length(word) THEN '</w>' ELSE '' END) AS r,
  sum(n) AS n FROM places GROUP BY 1, 2, 3),
merges AS (SELECT row_number() OVER (ORDER BY level, n DESC, l, r) - 1 AS rank, l, r FROM letter_pairs
  QUALIFY rank < {MAX_MERGES}),
bytes AS (SELECT b, (b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255) AS shown
  FROM range(256) t(b)),
alphabet AS (SELECT b, shown, CASE WHEN shown THEN chr(b::INT)
  ELSE chr((255 + sum(CASE WHEN shown THEN 0 ELSE 1 END) OVER (ORDER BY b))::INT) END AS symbol FROM bytes),
numbered AS (SELECT row_number() OVER (ORDER BY NOT shown, b) - 1 AS id, symbol FROM alphabet),
vocab AS (SELECT id, symbol AS token FROM numbered
  UNION ALL SELECT id + 256, symbol || '</w>' FROM numbered
  UNION ALL SELECT rank + 512, l || r FROM merges
  UNION ALL SELECT count(*) + 512, '<|startoftext|>' FROM merges
  UNION ALL SELECT count(*) + 513, '<|endoftext|>' FROM merges)"""


def encoded(source: str, key: str, column: str) -> str:
    """CTE `encoded(key, ids)`, plus `word_ids(word, ids)`; needs a recursive WITH.

    A word is a text of symbols with a space on either side. Each step joins
    every place of its best-ranked pair, from left to right.
    """
    return f"""{MERGES}, {words(source, key, column)},
distinct_words AS (SELECT DISTINCT unnest(words) AS word FROM words),
spelled AS (SELECT word, hex(encode(word)) AS h FROM distinct_words
  WHERE word NOT IN ('<|startoftext|>', '<|endoftext|>')),
letters AS (SELECT word, i, length(h) // 2 AS n,
  16 * (strpos('0123456789ABCDEF', h[2 * i - 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i]) - 1 AS b
  FROM (SELECT word, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM spelled)),
starts AS (SELECT word, string_agg(concat(' ', symbol, CASE WHEN i = n THEN '</w>' ELSE '' END, ' '), '' ORDER BY i) AS s
  FROM letters JOIN alphabet USING (b) GROUP BY word),
steps(step, word, s) AS (
  SELECT 0, word, s FROM starts
  UNION ALL
  SELECT step + 1, word, replace(s, concat(' ', l, '  ', r, ' '), concat(' ', l, r, ' '))
  FROM (SELECT step, word, s, arg_min(m.l, m.rank) AS l, arg_min(m.r, m.rank) AS r
        FROM (SELECT step, word, s, unnest(list_zip(parts[1:len(parts) - 1], parts[2:len(parts)])) AS p
              FROM (SELECT step, word, s, string_split(trim(s), '  ') AS parts FROM steps)) q
        JOIN merges m ON m.l = q.p[1] AND m.r = q.p[2]
        GROUP BY step, word, s)),
final_words AS (SELECT word, string_split(trim(arg_max(s, step)), '  ') AS parts FROM steps GROUP BY word
  UNION ALL SELECT word, [word] FROM distinct_words WHERE word IN ('<|startoftext|>', '<|endoftext|>')),
symbol_ids AS (SELECT token, max(id) AS id FROM vocab GROUP BY token),
word_ids AS (SELECT word, list(id ORDER BY i) AS ids FROM
  (SELECT word, unnest(parts) AS token, generate_subscripts(parts, 1) AS i FROM final_words)
  JOIN symbol_ids USING (token) GROUP BY word),
encoded AS (SELECT k.{key}, coalesce(e.ids, []) AS ids FROM words k LEFT JOIN (
  SELECT {key}, flatten(list(ids ORDER BY i)) AS ids FROM
    (SELECT {key}, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM words)
    JOIN word_ids USING (word) GROUP BY {key}) e USING ({key}))"""


def tokenized(key: str) -> str:
    """Frame of `encoded`, as the columns of a token table."""
    return f"""SELECT {key}, array_to_string(list_concat([n + 512], ids, [n + 513],
    list_transform(range(greatest(0, {CONTEXT_LENGTH} - 2 - len(ids))), lambda i: 0))[1:{CONTEXT_LENGTH}], ',') AS description_ids,
  (len(ids) + 2)::INT AS n_tokens, (len(ids) + 2 > {CONTEXT_LENGTH})::INT AS truncated
FROM encoded, (SELECT count(*) AS n FROM merges)"""


# Hashes: the 32-bit Murmur3 that Spark's hash() uses, with its seed 42

_MASK = "4294967295::UBIGINT"


def _mul(x: str, factor: int) -> str:
    return f"(({x} * {factor}::UBIGINT) & {_MASK})"


def _rotl(x: str, bits: int) -> str:
    return f"((({x} << {bits}) & {_MASK}) | ({x} >> {32 - bits}))"


def murmur(source: str, key: str, blocks: str, length: str) -> str:
    """CTEs ending in `hashed(key, hash)`; ``blocks`` is a list of unsigned 32-bit words."""
    mixed = _mul("k", 0xCC9E2D51)
    turned = _mul(_rotl("k", 15), 0x1B873593)
    step = f"(({_rotl('xor(h, k)', 13)} * 5::UBIGINT + {0xE6546B64}::UBIGINT) & {_MASK})"
    return f"""h0 AS (SELECT {key}, {blocks} AS ks, ({length})::UBIGINT AS len FROM {source}),
h1 AS (SELECT {key}, len, list_transform(list_transform(ks, lambda k: {mixed}), lambda k: {turned}) AS ks FROM h0),
h2 AS (SELECT {key}, xor(list_reduce(list_concat([42::UBIGINT], ks), lambda h, k: {step}), len) AS h FROM h1),
h3 AS (SELECT {key}, {_mul("xor(h, h >> 16)", 0x85EBCA6B)} AS h FROM h2),
h4 AS (SELECT {key}, {_mul("xor(h, h >> 13)", 0xC2B2AE35)} AS h FROM h3),
hashed AS (SELECT {key}, CASE WHEN f >= 2147483648 THEN f::BIGINT - 4294967296 ELSE f::BIGINT END AS hash
  FROM (SELECT {key}, xor(h, h >> 16) AS f FROM h4))"""


def int_blocks(column: str) -> str:
    """Words of a non-negative int."""
    return f"[{column}::UBIGINT]"


def bigint_blocks(column: str) -> str:
    """Words of a non-negative bigint, low half first."""
    return f"[{column}::UBIGINT & {_MASK}, {column}::UBIGINT >> 32]"


def text_blocks(column: str) -> str:
    """Whole four-byte words, low byte first, then every further byte with its sign."""
    h = f"hex(encode({column}))"
    n = f"(length({h}) // 2)"

    def byte(at: str) -> str:
        return (
            f"(16 * (strpos('0123456789ABCDEF', substr({h}, 2 * ({at}) + 1, 1)) - 1)"
            f" + strpos('0123456789ABCDEF', substr({h}, 2 * ({at}) + 2, 1)) - 1)"
        )

    word = " + ".join(f"{byte(f'4 * i + {j}')} * {256**j}" for j in range(4))
    rest = byte("i")
    return (
        f"list_concat(list_transform(range({n} // 4), lambda i: ({word})::UBIGINT), "
        f"list_transform(range({n} // 4 * 4, {n}), lambda i: ({rest} + CASE WHEN {rest} >= 128 THEN 4294967040 ELSE 0 END)::UBIGINT))"
    )


def label(hash_sql: str) -> str:
    return f"CASE WHEN abs({hash_sql}) % 16 < 14 THEN 'training' ELSE 'validation' END"


INT_LABEL = murmur("documents", "doc_id", int_blocks("doc_id"), "4")
INT_SPLIT = f"WITH {INT_LABEL}, labelled AS (SELECT d.*, {label('hash')} AS dataset FROM documents d JOIN hashed USING (doc_id))"
LABELLED_PAIRS = (
    INT_SPLIT
    + ", pairs AS (SELECT l.doc_id AS product_id, dataset, text, quality, toxic FROM labelled l JOIN labels s ON l.doc_id = s.doc_id)"
)


def renamed_murmur(tag: str, blocks: str, length: str) -> str:
    sql = murmur("documents", "doc_id", blocks, length)
    for name in ("h0", "h1", "h2", "h3", "h4", "hashed"):
        sql = sql.replace(f"{name} AS", f"{name}_{tag} AS").replace(f"FROM {name}", f"FROM {name}_{tag}")
    return sql


# Vectors


def scaled(values: str, factor: float) -> str:
    return f"array_to_string(list_transform({values}, lambda x: round(x::DOUBLE * {factor:.0f})::BIGINT), ',')"


_UNIT = "list_transform({v}::DOUBLE[], lambda x: x / sqrt(list_dot_product({v}::DOUBLE[], {v}::DOUBLE[])))"


def project(element: str) -> str:
    """Product of the 64 values with the matrix ((i * 7 + j) mod 5) - 2."""
    return (
        f"list_transform(range({PROJECTED}), lambda j: {element.format(s=f'''list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * ((i * 7 + j) % 5 - 2)))''')})"
    )


PAIRS = f"""pairs AS (SELECT a.vec_id // 2 // {BATCH} AS batch_id, (a.vec_id // 2 % {BATCH})::INT AS pos,
  {_UNIT.format(v="a.embedding")} AS img, {_UNIT.format(v="b.embedding")} AS txt
  FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1),
combos AS (SELECT i.batch_id, i.pos AS i, t.pos AS t, exp({LOGIT_SCALE!r}) * list_dot_product(i.img, t.txt) AS logit
  FROM pairs i JOIN pairs t USING (batch_id)),
by_img AS (SELECT batch_id, i AS pos, list(logit ORDER BY t) AS logits, max(logit) AS top,
  max(logit) FILTER (WHERE i = t) AS own FROM combos GROUP BY ALL),
by_txt AS (SELECT batch_id, t AS pos, list(logit ORDER BY i) AS logits, max(logit) AS top,
  max(logit) FILTER (WHERE i = t) AS own FROM combos GROUP BY ALL),
predictions AS (SELECT batch_id, pos,
  (list_position(a.logits, a.top) - 1)::INT AS pred_img, (list_position(b.logits, b.top) - 1)::INT AS pred_txt,
  0.5 * (ln(list_sum(list_transform(a.logits, lambda x: exp(x - a.top)))) + a.top - a.own)
  + 0.5 * (ln(list_sum(list_transform(b.logits, lambda x: exp(x - b.top)))) + b.top - b.own) AS loss
  FROM by_img a JOIN by_txt b USING (batch_id, pos))"""


def scores(source: str) -> str:
    return f"""sides AS (SELECT 'img' AS direction, pos AS label, pred_img AS pred FROM {source}
  UNION ALL SELECT 'text', pos, pred_txt FROM {source}),
classes AS (SELECT direction, label AS class FROM sides UNION SELECT direction, pred FROM sides),
per_class AS (SELECT c.direction, class,
  count(*) FILTER (WHERE label = class AND pred = class) AS tp,
  count(*) FILTER (WHERE label = class) AS actual, count(*) FILTER (WHERE pred = class) AS guessed
  FROM classes c JOIN sides s ON c.direction = s.direction AND (label = class OR pred = class) GROUP BY ALL),
macro AS (SELECT direction, avg(CASE WHEN guessed > 0 THEN tp / guessed ELSE 0 END) AS prec,
  avg(CASE WHEN actual > 0 THEN tp / actual ELSE 0 END) AS rec,
  avg(2 * tp / (actual + guessed)) AS f FROM per_class GROUP BY direction),
acc AS (SELECT direction, avg((label = pred)::INT::DOUBLE) AS acc FROM sides GROUP BY direction),
losses AS (SELECT batch_id, avg(loss) AS loss FROM {source} GROUP BY batch_id)"""


def report(source: str) -> str:
    columns = [
        f"(SELECT round({c}, 6) FROM {t} WHERE direction = '{d}') AS eval_{n}_{d}"
        for d in ("img", "text")
        for n, t, c in (("acc", "acc", "acc"), ("prec", "macro", "prec"), ("rec", "macro", "rec"), ("f_score", "macro", "f"))
    ]
    return f"{scores(source)} SELECT (SELECT round(avg(loss), 6) FROM losses) AS eval_loss, " + ", ".join(columns)


def _cubic(x: str, a: str, b: str) -> str:
    """The round function of a shuffled epoch, modulo the prime 2 ** 31 - 1."""
    return f"((({x} + {a}) % 2147483647 * (({x} + {a}) % 2147483647)) % 2147483647 * (({x} + {b}) % 2147483647)) % 2147483647"


def _feistel(source: str, tag: str) -> str:
    """CTEs ending in `q{tag}(doc_id, epoch, ks, spot)`, the places ``spot`` of ``source`` after six rounds."""
    rounds = [f"p{tag}_0 AS (SELECT doc_id, epoch, ks, spot // h AS l, spot % h AS r, w, h FROM {source}, grid)"]
    for n in range(6):
        a, b = f"ks[{2 * n + 1}]", f"ks[{2 * n + 2}]"
        left = "l" if n % 2 else f"(l + {_cubic('r', a, b)}) % w"
        right = f"(r + {_cubic('l', a, b)}) % h" if n % 2 else "r"
        rounds.append(f"p{tag}_{n + 1} AS (SELECT doc_id, epoch, ks, {left} AS l, {right} AS r, w, h FROM p{tag}_{n})")
    rounds.append(f"q{tag} AS (SELECT doc_id, epoch, ks, l * h + r AS spot FROM p{tag}_6)")
    return ", ".join(rounds)


def shuffled(seed: int, first: int, epochs: int) -> str:
    """CTEs ending in `shuffled(doc_id, epoch, spot)`: all places of the epochs; surplus places are moved on up to three times."""
    key = _cubic("x", "161803398", "141421356")
    return f"""total AS (SELECT count(*) AS n, floor(sqrt(count(*) - 1))::BIGINT + 1 AS root FROM documents),
grid AS (SELECT w, (n + w - 1) // w AS h FROM (SELECT n, unnest(range(root, root + least(2048, root // 4 + 2))) AS w FROM total)
  ORDER BY w * ((n + w - 1) // w) - n, w LIMIT 1),
starts AS (SELECT epoch, i, ({_cubic(f"{seed}::BIGINT", "314159265", "271828182")} + epoch * 6 + i) % 2147483647 AS x
  FROM range({first}, {first + epochs}) t(epoch), range(6) u(i)),
firsts AS (SELECT epoch, i, {key} AS a FROM starts),
keyed AS (SELECT epoch, flatten(list([a, {_cubic("a", "577215664", "693147180")}] ORDER BY i)) AS ks FROM firsts GROUP BY epoch),
numbered AS (SELECT doc_id, epoch, ks, row_number() OVER (PARTITION BY epoch ORDER BY doc_id) - 1 AS spot FROM documents, keyed),
{_feistel("numbered", "a")},
wa AS (SELECT q.* FROM qa q, total WHERE spot >= n), {_feistel("wa", "b")},
wb AS (SELECT q.* FROM qb q, total WHERE spot >= n), {_feistel("wb", "c")},
wc AS (SELECT q.* FROM qc q, total WHERE spot >= n), {_feistel("wc", "d")},
shuffled AS (SELECT doc_id, epoch, spot FROM (FROM qa UNION ALL FROM qb UNION ALL FROM qc UNION ALL FROM qd), total WHERE spot < n)"""


BEST = f"""scored AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(
  list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])
  / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))
  / sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])), 9) AS score
  FROM embeddings q CROSS JOIN embeddings c)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank, id, round(score, 6) AS score
FROM scored QUALIFY rank <= {TOP_K}"""

_BYTE = "floor((x::DOUBLE + 1) * 127.5)::BIGINT"
_INDEXED_TENSOR = "list_concat(embedding, embedding, embedding)"


def channels() -> str:
    planes = [
        f"list_transform(embedding, lambda x: (x::DOUBLE / 2 - {m!r}) / {s!r})"
        for m, s in zip(CHANNEL_MEAN, CHANNEL_STD, strict=True)
    ]
    return "list_concat(" + ", ".join(planes) + ")"


ORACLE: dict[str, str] = {
    "scan_products": f"WITH {PRODUCTS} SELECT * FROM products",
    "scan_pruned": "SELECT doc_id, n_chars FROM documents",
    "sink_roundtrip": "SELECT doc_id, md5(text) AS text, lang, source, n_chars FROM documents",
    "write_training_set": f"{LABELLED_PAIRS} SELECT product_id::INT AS product_id, dataset, md5(text) AS text, quality, toxic FROM pairs",
    "split_files": f"{LABELLED_PAIRS} SELECT dataset, CASE dataset WHEN 'training' THEN 7::BIGINT ELSE 3 END AS n_files, count(*) AS n_rows FROM pairs GROUP BY ALL",
    "category_stats": f"""WITH {PRODUCTS} SELECT product_family, product_category,
        array_to_string(list_sort(list(DISTINCT product_sub_category)), '|') AS product_sub_categories,
        count(*) AS product_category_count FROM products GROUP BY ALL""",
    "rare_category_anti": f"WITH {PRODUCTS}, {rare()} SELECT product_id, product_family, product_category FROM common",
    "family_exclusion": f"WITH {PRODUCTS} SELECT product_id, product_family FROM products WHERE product_family NOT IN ({_FAMILIES})",
    "null_sentinels": f"WITH {PRODUCTS}, {CLEANED.format(source='products')} SELECT * EXCLUDE (product_attributes) FROM cleaned",
    "product_facets": f"WITH {PRODUCTS}, {CLEANED.format(source='products')}, {FACETS} SELECT * FROM facets",
    "parse_attributes": f"""WITH {PRODUCTS}, {parsed("products")} SELECT product_id, len(attrs)::INT AS n_attributes,
        array_to_string(list_transform(attrs, lambda a: a.attribute_name), '|') AS names FROM parsed""",
    "explode_attributes": f"""WITH {PRODUCTS}, {parsed("products")} SELECT product_id, attribute_name,
        array_to_string(attribute_values, '|') AS attribute_values FROM attributes""",
    "attribute_stats": f"""WITH {PRODUCTS}, {parsed("products")}, listed AS (SELECT attribute_name, unnest(attribute_values) AS v FROM attributes),
        vs AS (SELECT attribute_name, array_to_string(list_sort(list(DISTINCT v)), '|') AS attribute_values FROM listed GROUP BY 1)
        SELECT attribute_name, attribute_values, n_rows FROM vs JOIN
        (SELECT attribute_name, count(*) AS n_rows FROM attributes GROUP BY 1) USING (attribute_name)""",
    "rare_attribute_anti": f"""WITH {PRODUCTS}, {parsed("products")}, {FREQUENT} SELECT product_id, attribute_name,
        array_to_string(attribute_values, '|') AS attribute_values FROM frequent""",
    "attribute_filter": f"""WITH {PRODUCTS}, {parsed("products")}, {single("attributes")} SELECT * FROM single""",
    "attributes_per_product": f"""WITH {PRODUCTS}, {parsed("products")}, {FREQUENT}, {single("frequent")}, {VALUES}
        SELECT product_id, array_to_string(attribute_values, '|') AS attribute_values FROM vals""",
    "products_with_attributes": _WITH_VALUES,
    "products_with_attributes_in_row": _WITH_VALUES,
    "verbalize_list": f"""WITH {PRODUCTS}, {parsed("products")}, lists AS (SELECT product_id, attribute_values AS items FROM attributes
        UNION ALL SELECT product_id, list_transform(attrs, lambda a: a.attribute_name) FROM parsed)
        SELECT product_id, {PHRASE.format(x="items")} AS phrase FROM lists WHERE len(items) > 0""",
    "verbalize": f"WITH {described()} SELECT product_id, description FROM described",
    "verbalize_in_row": f"WITH {described()} SELECT product_id, description FROM described",
    "clean_text": f"""WITH twice AS (SELECT page_id, {squeezed(unescaped("once"))} AS cleaned FROM
        (SELECT page_id, {unescaped("html")} AS once FROM pages))
        SELECT page_id, length(cleaned)::INT AS n_chars, md5(cleaned) AS cleaned FROM twice""",
    "pretokenize": f"WITH {DOC_WORDS} SELECT doc_id, len(words)::INT AS n_words, md5(array_to_string(words, ' ')) AS words FROM words",
    "frame_sequence": f"""WITH {FRAMED} SELECT doc_id, array_to_string(framed, ',') AS ids, n_tokens::INT AS n_tokens,
        (n_tokens > {CONTEXT_LENGTH})::INT AS truncated FROM framed""",
    "eot_position": f"WITH {FRAMED} SELECT doc_id, (list_position(framed, list_max(framed)) - 1)::INT AS position FROM framed",
    "bpe_vocab": f"WITH {MERGES} SELECT id::INT AS id, token FROM vocab",
    "bpe_encode": f"""WITH RECURSIVE {encoded("documents", "doc_id", "text")}
        SELECT doc_id, len(ids)::INT AS n_ids, md5(array_to_string(ids, ',')) AS ids FROM encoded""",
    "bpe_words": f"""WITH RECURSIVE {encoded("documents", "doc_id", "text")}
        SELECT word, n_texts, array_to_string(ids, ',') AS ids FROM word_ids JOIN (SELECT word, count(*) AS n_texts FROM
        (SELECT unnest(list_distinct(words)) AS word FROM words) GROUP BY word) USING (word)""",
    "bpe_decode": f"""WITH {DOC_WORDS}, joined AS (SELECT doc_id, array_to_string(list_transform(words, lambda w: w || ' '), '') AS t FROM words)
        SELECT doc_id, length(t)::INT AS n_chars, md5(t) AS text FROM joined""",
    "tokenize_table": f"""WITH RECURSIVE {encoded("documents", "doc_id", "text")} {tokenized("doc_id")}""",
    "tokenize_products": f"""WITH RECURSIVE {described()}, {encoded("described", "product_id", "description")} {tokenized("product_id")}""",
    "path_to_key": r"SELECT page_id, regexp_replace(string_split(url, '/')[-1], '\.html$', '') AS key FROM pages",
    "hash_shard": f"""WITH {murmur("pages", "page_id", text_blocks("url"), "length(hex(encode(url))) // 2")}
        SELECT page_id, (abs(hash) % 10)::INT AS shard FROM hashed""",
    "pair_large_keys": "SELECT d.doc_id + 3000000000 AS product_id, md5(text) AS text, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "pair_unusable": "SELECT 'image' AS side, 'x' || doc_id AS key, count(*) AS n FROM labels WHERE toxic = 1 GROUP BY ALL",
    "category_values": f"""WITH {PRODUCTS} SELECT product_family, product_category, product_sub_category, count(*) AS n_rows FROM products GROUP BY ALL""",
    "category_chunks": f"""WITH {PRODUCTS}, numbered AS (SELECT product_family, product_sub_category AS v,
        (row_number() OVER (PARTITION BY product_family ORDER BY product_sub_category) - 1) // 3 AS chunk
        FROM (SELECT DISTINCT product_family, product_sub_category FROM products WHERE product_sub_category IS NOT NULL)),
        totals AS (SELECT product_family, count(*) AS n_rows FROM products GROUP BY ALL)
        SELECT product_family, array_to_string(list(v ORDER BY v), '|') AS names, n_rows, chunk
        FROM numbered JOIN totals USING (product_family) GROUP BY product_family, n_rows, chunk""",
    "attribute_values": f"""WITH {PRODUCTS}, {parsed("products")}, listed AS (SELECT attribute_name, unnest(attribute_values) AS value,
        generate_subscripts(attribute_values, 1) AS i FROM attributes)
        SELECT attribute_name, value, count(*) FILTER (WHERE i = 1) AS n_rows FROM listed GROUP BY ALL""",
    "product_values": f"""WITH {PRODUCTS}, {parsed("products")}, {FREQUENT}, {single("frequent")}, {VALUES}
        SELECT product_id, unnest(attribute_values) AS attribute_values FROM vals""",
    "pair_inner": "SELECT d.doc_id AS product_id, md5(text) AS text, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "split_label": f"""WITH {renamed_murmur("i", int_blocks("doc_id"), "4")}, {renamed_murmur("l", bigint_blocks("doc_id"), "8")},
        {renamed_murmur("s", text_blocks("doc_id::VARCHAR"), "length(doc_id::VARCHAR)")}
        SELECT doc_id, {label("i.hash")} AS by_int_hash, {label("l.hash")} AS by_bigint_hash, {label("s.hash")} AS by_string_hash,
        {label("doc_id")} AS by_key FROM hashed_i i JOIN hashed_l l USING (doc_id) JOIN hashed_s s USING (doc_id)""",
    "split_counts": f"{INT_SPLIT} SELECT dataset, count(*) AS n_rows FROM labelled GROUP BY 1",
    "work_shard": """SELECT doc_id % (SELECT ceil(count(*) / 100)::BIGINT FROM documents) AS shard, count(*) AS n_rows,
        sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1""",
    "map_rows": "SELECT doc_id, n_chars * 2 AS n_chars, lang FROM documents",
    "assign_batches": f"""SELECT doc_id, epoch::INT AS epoch, i // {BATCH} AS batch_id, (i % {BATCH})::INT AS pos FROM
        (SELECT doc_id, epoch, row_number() OVER (ORDER BY epoch, doc_id) - 1 AS i FROM documents, range(2) t(epoch))""",
    "shuffled_batches": f"""SELECT i // {BATCH} AS batch_id, count(*) AS n_rows, min(i % {BATCH})::INT AS first_pos, max(i % {BATCH})::INT AS last_pos,
        min(i // n)::INT AS first_epoch, max(i // n)::INT AS last_epoch FROM
        (SELECT unnest(range(3 * n)) AS i, n FROM (SELECT count(*) AS n FROM documents)) GROUP BY 1""",
    "shuffled_epochs": """SELECT epoch::INT AS epoch, count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs,
        sum(n_chars)::BIGINT AS n_chars FROM documents, range(3) t(epoch) GROUP BY 1""",
    "epoch_order": f"""WITH {shuffled(11, 4, 3)}, dealt AS (SELECT doc_id, epoch, spot + (epoch - 4) * n AS i FROM shuffled, total)
        SELECT doc_id, epoch::INT AS epoch, i // {BATCH} AS batch_id, (i % {BATCH})::INT AS pos FROM dealt""",
    "single_batch": f"SELECT doc_id, lang, (row_number() OVER (ORDER BY doc_id) - 1)::INT AS pos FROM documents QUALIFY pos < {BATCH}",
    "file_batches": f"""SELECT doc_id, i // {BATCH} AS slice_id, (i % {BATCH})::INT AS pos FROM
        (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)""",
    "file_shards": """SELECT w AS worker, n AS n_files, NULL::BIGINT AS n_rows FROM (VALUES (0, 3::BIGINT), (1, 2), (2, 2)) t(w, n)
        UNION ALL SELECT -1, 7, count(*) FROM documents""",
    "l2_normalize": f"""WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 5 + 1)) AS v FROM embeddings)
        SELECT vec_id, {scaled(_UNIT.format(v="v"), 1e6)} AS v FROM g""",
    "channel_normalize": f"SELECT vec_id, {scaled(channels(), 1e6)} AS t FROM embeddings",
    "project_embedding": f"SELECT vec_id, {scaled(project('{s}'), 1e6)} AS shared FROM embeddings",
    "embed_table": f"SELECT vec_id, {scaled(project('{s}::FLOAT'), 1e6)} AS shared FROM embeddings",
    "embed_rejects": f"""SELECT vec_id, CASE WHEN label NOT IN (3, 7) THEN {scaled(project('{s}'), 1e4)} END AS shared,
        CASE label WHEN 7 THEN 'ValueError: 63 values, not 64' WHEN 3 THEN 'ValueError: no input' END AS error FROM embeddings""",
    "tensor_roundtrip": f"SELECT vec_id, '4,16' AS shape, {scaled('embedding', 1e6)} AS v FROM embeddings",
    "reject_split": """SELECT vec_id, CASE WHEN label = 7 THEN NULL ELSE round(list_max(embedding)::DOUBLE, 6) END AS largest,
        CASE WHEN label = 7 THEN 'ValueError: not 64 values' END AS error FROM embeddings""",
    "inbatch_logits": f"""WITH {PAIRS} SELECT batch_id, pos, {scaled("a.logits", 1e6)} AS img_logits, {scaled("b.logits", 1e6)} AS txt_logits
        FROM by_img a JOIN by_txt b USING (batch_id, pos)""",
    "pair_logit": f"WITH {PAIRS} SELECT batch_id, pos, round(own, 6) AS logit FROM by_img",
    "inbatch_top1": f"WITH {PAIRS} SELECT batch_id, pos, pred_img, pred_txt FROM predictions",
    "retrieval_accuracy": f"WITH {PAIRS}, {scores('predictions')} SELECT direction, round(acc, 6) AS accuracy FROM acc",
    "retrieval_prf_macro": f"""WITH {PAIRS}, {scores("predictions")} SELECT direction, round(prec, 6) AS precision,
        round(rec, 6) AS recall, round(f, 6) AS f_score FROM macro""",
    "contrastive_loss": f"WITH {PAIRS}, {scores('predictions')} SELECT batch_id, round(loss, 6) AS loss FROM losses",
    "eval_report": f"WITH {PAIRS}, {report('predictions')}",
    "eval_report_steps": f"WITH {PAIRS}, limited AS (SELECT * FROM predictions WHERE batch_id < 3), {report('limited')}",
    "topk_retrieval": f"WITH {BEST}",
    "embedding_parity": """WITH b AS (SELECT CASE WHEN label = 3 THEN vec_id + 1000000 ELSE vec_id END AS id,
        list_transform(embedding, lambda x: round(x::DOUBLE, 3)) AS v FROM embeddings),
        j AS (SELECT a.vec_id AS l, b.id AS r, a.embedding::DOUBLE[] AS x, b.v AS y FROM embeddings a FULL JOIN b ON a.vec_id = b.id)
        SELECT count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS n_compared, count(*) FILTER (WHERE r IS NULL) AS n_left_only,
        count(*) FILTER (WHERE l IS NULL) AS n_right_only, 0::BIGINT AS n_size_differs,
        count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL AND (x IS NULL OR y IS NULL)) AS n_null_vectors,
        round(max(list_max(list_transform(range(1, 65), lambda i: abs(x[i] - y[i])))) FILTER (WHERE l = r), 9) AS max_abs_diff FROM j""",
    "running_best": """WITH h AS (SELECT user_id AS run, date_diff('day', DATE '2024-01-01', ts::DATE) AS epoch,
        sum(round(value * 100)::BIGINT)::BIGINT / count(*) AS metric FROM events GROUP BY ALL)
        SELECT run, epoch::INT AS epoch, round(metric, 6) AS metric, (metric > coalesce(max(metric) OVER (PARTITION BY run ORDER BY epoch
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS is_best FROM h WHERE epoch % 3 = 0""",
    "stream_binary_scan": f"""WITH hexed AS (SELECT vec_id, label, array_to_string(list_transform({_INDEXED_TENSOR},
        lambda x: printf('%02X', {_BYTE})), '') AS h FROM embeddings),
        cut AS (SELECT vec_id, CASE WHEN label = 7 THEN h[1:382] ELSE h END AS h FROM hexed)
        SELECT vec_id::VARCHAR AS product_id, length(h) // 2 AS n_bytes, md5(unhex(h)) AS content FROM cut""",
    "stream_shard_sink": f"""SELECT vec_id::VARCHAR AS product_id, (label = 7)::INT AS rejected,
        CASE WHEN label = 7 THEN NULL ELSE list_sum(list_transform({_INDEXED_TENSOR}, lambda x: {_BYTE}))::BIGINT END AS byte_sum,
        1 AS in_range FROM embeddings""",
    "stream_training_set": f"""WITH RECURSIVE {described()}, {encoded("described", "product_id", "description")},
        sized AS (SELECT product_id, (len(ids) + 2)::INT AS n_tokens FROM encoded),
        {murmur("sized", "product_id", int_blocks("product_id"), "4")},
        planes AS (SELECT vec_id, label, list_transform({_INDEXED_TENSOR}, lambda x: {_BYTE} / 255) AS x FROM embeddings),
        scored AS (SELECT vec_id, label, list_sum(list_transform(range(192), lambda i:
            (((x[i + 1] - [{", ".join(map(repr, CHANNEL_MEAN))}][i // 64 + 1]) / [{", ".join(map(repr, CHANNEL_STD))}][i // 64 + 1])::FLOAT)::DOUBLE
            * (i + 1))) AS weighed FROM planes)
        SELECT vec_id::VARCHAR AS product_id, CASE WHEN label = 7 THEN 'rejected' WHEN n_tokens IS NULL THEN 'unmatched'
            ELSE {label('hash')} END AS dataset, CASE WHEN label = 7 THEN NULL ELSE n_tokens END AS n_tokens,
            CASE WHEN label = 7 THEN NULL ELSE round(weighed, 2) END AS weighed
        FROM scored LEFT JOIN sized ON vec_id = sized.product_id LEFT JOIN hashed ON vec_id = hashed.product_id""",
    "train_batches": f"""WITH RECURSIVE {described()}, {encoded("described", "product_id", "description")},
        sized AS (SELECT product_id, (len(ids) + 2)::INT AS n_tokens FROM encoded JOIN embeddings ON vec_id = product_id),
        {murmur("sized", "product_id", int_blocks("product_id"), "4")}
        SELECT product_id, n_tokens, 0 AS epoch, i // {BATCH} AS batch_id, (i % {BATCH})::INT AS pos FROM
        (SELECT product_id, n_tokens, row_number() OVER (ORDER BY product_id) - 1 AS i FROM sized JOIN hashed USING (product_id)
        WHERE abs(hash) % 16 < 14)""",
}
ORACLE["eval_report_dealt"] = ORACLE["eval_report"]
ORACLE["eval_report_tiles"] = ORACLE["eval_report"]
