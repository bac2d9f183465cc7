"""The operators of this subpackage as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklane.llm import token_files

    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json")))


def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklane.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklane.llm.style_tree import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklane.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklane.llm import warc

    return warc.read(warc.write(table(spark, sf_dir, "pages"))).drop("url")


def op6_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklane.llm.secret_scan import find

    return find(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklane.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op8_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklane.llm.token_counts import count

    return count(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklane.llm.repeats import remove

    return remove(table(spark, sf_dir, "documents"))


def op10_rare_seed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklane.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op11_prefix_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklane.llm import prefix_trie

    head = F.crc32(F.col("conv_id").cast("string")) % 9
    turns = prefix_trie.numbered(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.shared(turns, 5, head, 8)).drop("ka", "kb")


def op12_byte_bpe_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tracklane.llm import byte_bpe

    path = _tokenizer("byte_bpe_multi_50k.tiktoken")
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    return ids.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import zlib

    from tracklane.llm import runs

    def repeat(doc_id: int, n: int) -> tuple[int, int] | None:
        g, tenth = divmod(zlib.crc32(str(doc_id).encode()), 10)
        return None if tenth else (g % n, 1 + (n - g % n) // (3 + g % 8))

    return runs.digest(runs.find(table(spark, sf_dir, "documents"), repeat))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_rans_token_files, op2_decision_list, op3_style_tree, op4_simhash_variants, op5_warc, op6_markov_secrets, op7_best_fit_packing, op8_pretoken_counts, op9_repeated_strings,
        op10_rare_seed_alignment, op11_prefix_bands, op12_byte_bpe_fold, op13_periodic_runs)
}
SQL: dict[str, str] = {
    "op11_prefix_bands": """
        with orig as (
            select conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first, coalesce(role, '')) as own
            from conversations where conv_id is not null group by conv_id),
        crc as (
            select conv_id, own, xor(list_reduce([ascii(x) for x in string_split(conv_id::varchar, '')], lambda c, b:
                list_reduce(range(8), lambda v, i: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, xor(c, b::bigint)),
                4294967295::bigint), 4294967295) % 9 as h from orig),
        rebuilt as (
            select c.conv_id, case when c.conv_id % 5 = 0 then c.own else list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) end as l
            from crc c left join orig b on b.conv_id = c.conv_id - c.conv_id % 5),
        prefix as (
            select conv_id, d, len(l) = d as ends, l[1:d] as p, case when d > 0 then strlen(l[d].t) else 0 end as bytes
            from (select conv_id, l, unnest(range(0, len(l) + 1)) as d from rebuilt)),
        node as (
            select md5(p::varchar) as k, any_value(p) as p, d, min(conv_id) as conv_id, count(*) as n_convs, max(bytes) as bytes,
                sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
            from prefix group by md5(p::varchar), d),
        child as (select md5(p[1:d - 1]::varchar) as k, count(*) as n from node where d > 0 group by 1),
        tree as (select n.*, coalesce(c.n, 0) as n_children from node n left join child c using (k)),
        total as (
            select md5(p[1:a]::varchar) as k, sum((n_children = 0)::bigint) as n_leaves, sum((n_convs - 1) * bytes) as saved_tokens
            from (select *, unnest(range(0, d + 1)) as a from tree) group by 1)
        select t.conv_id, t.d as depth, u.conv_id as parent_conv_id, t.n_convs, t.n_children, s.n_leaves::bigint as n_leaves,
            s.saved_tokens::bigint as saved_tokens, t.ends_sha256
        from tree t join total s using (k) left join tree u on t.d > 0 and u.k = md5(t.p[1:t.d - 1]::varchar)""",
    "op5_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        d as (select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest from p),
        f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first from d)
        select page_id, payload_bytes, payload_digest,
            case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
            case when first <> page_id then first end as refers_to
        from f""",
}
