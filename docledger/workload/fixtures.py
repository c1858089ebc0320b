"""Derived inputs: the driver tables seen as printed business documents.

Each fixture is one SQL common table expression in the subset both engines understand, so that the
operators and their oracles start from the same rows. Only the *inputs* share text; every
operator is a DataFrame function and every oracle is separate SQL.

No fixture restricts its table: all orders, line items, documents, parts, events and embeddings
take part. Modulo terms only vary printed forms or damage predictions, as real runs do.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


#: Tables that stay a handful of rows at every scale.
SMALL = ("region", "nation")


class Dialect:
    """The few spellings that differ between the two engines."""

    def __init__(self, engine: str) -> None:
        self.spark = engine == "spark"

    def words(self) -> str:
        if self.spark:
            return (
                "select doc_id as doc_key, cast(k as bigint) as tok, word from documents "
                r"lateral view posexplode(filter(split(text, '[ \\n\\t\\r]+'), x -> x <> '')) t as k, word"
            )
        return (
            "select doc_id as doc_key, cast(unnest(range(len(ws))) as bigint) as tok, unnest(ws) as word "
            "from (select doc_id, list_filter(string_split_regex(text, '[ \\n\\t\\r]+'), lambda x: x <> '') as ws "
            "from documents)"
        )

    def unpivot(self, source: str, keep: str, names: tuple[str, ...], rows: list[tuple[str, ...]]) -> str:
        """One pass over ``source``: every row of expressions becomes one output row.

        Spark computes the cells below the generator, each different one once: one generated method for
        both would be too long for the JVM to compile and would run interpreted.
        """
        if self.spark:
            known = {expr: f"_cell{k}" for k, expr in enumerate(dict.fromkeys(expr for row in rows for expr in row))}
            made = ", ".join(f"{expr} as {name}" for expr, name in known.items())
            cells = ", ".join(known[expr] for row in rows for expr in row)
            return (
                f"select {keep}, {', '.join(names)} from (select *, {made} from {source}) "
                f"lateral view stack({len(rows)}, {cells}) s as {', '.join(names)}"
            )
        packed = ", ".join(
            "struct_pack(" + ", ".join(f"{n} := {e}" for n, e in zip(names, row, strict=True)) + ")" for row in rows)
        return (
            f"select {keep}, {', '.join(f's.{n} as {n}' for n in names)} "
            f"from (select *, unnest([{packed}]) as s from {source})"
        )

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def sha256(self, text: str) -> str:
        return f"sha2({text}, 256)" if self.spark else f"sha256({text})"

    def div(self, left: str, right: str) -> str:
        return f"({left} div {right})" if self.spark else f"(({left}) // ({right}))"

    def listing(self, value: str, order: str, separator: str = ",") -> str:
        if self.spark:
            return f"listagg({value}, '{separator}') within group (order by {order})"
        return f"string_agg({value}, '{separator}' order by {order})"


def printed_date(expr: str) -> str:
    day, month, year = (f"cast(extract({p} from {expr}) as string)" for p in ("day", "month", "year"))
    return f"lpad({day}, 2, '0') || '/' || lpad({month}, 2, '0') || '/' || {year}"


def iso_date(expr: str) -> str:
    day, month, year = (f"cast(extract({p} from {expr}) as string)" for p in ("day", "month", "year"))
    return f"{year} || '-' || lpad({month}, 2, '0') || '-' || lpad({day}, 2, '0')"


def printed_money(d: Dialect, cents: str) -> str:
    """1234567 -> 12.345,67 ."""
    whole = d.div(cents, "100")
    low = f"lpad(cast({whole} % 1000 as string), 3, '0')"
    mid = f"lpad(cast({d.div(whole, '1000')} % 1000 as string), 3, '0')"
    tail = f"',' || lpad(cast({cents} % 100 as string), 2, '0')"
    return (
        f"case when {whole} < 1000 then cast({whole} as string) "
        f"when {whole} < 1000000 then cast({d.div(whole, '1000')} as string) || '.' || {low} "
        f"else cast({d.div(whole, '1000000')} as string) || '.' || {mid} || '.' || {low} end || {tail}"
    )


def plain_money(d: Dialect, cents: str) -> str:
    return f"cast({d.div(cents, '100')} as string) || '.' || lpad(cast({cents} % 100 as string), 2, '0')"


def _definitions(d: Dialect) -> dict[str, tuple[tuple[str, ...], str]]:
    """name -> (needed fixtures, select)."""
    defs: dict[str, tuple[tuple[str, ...], str]] = {}
    # printed invoice lines
    defs["fx_lines"] = ((), """
      select l_orderkey as doc_key,
        cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
          l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as bigint) as line_no,
        l_partkey as part_key, l_suppkey as supp_key, cast(l_quantity as bigint) as qty,
        cast(round(l_extendedprice * 100) as bigint) as cents, cast(round(l_tax * 100) as bigint) as rate,
        l_returnflag as flag, l_linestatus as line_status, l_shipdate as ship
      from lineitem""")
    defs["fx_sums"] = ((), f"""
      select l_orderkey as doc_key, count(*) as n_lines,
        cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as sub_cents,
        {d.div("cast(sum(cast(round(l_extendedprice * 100) as bigint) * cast(round(l_tax * 100) as bigint)) as bigint)", "100")} as vat_cents
      from lineitem group by l_orderkey""")
    defs["fx_head"] = (("fx_sums",), f"""
      select o.o_orderkey as doc_key, 'INV-' || lpad(cast(o.o_orderkey as string), 8, '0') as document_id,
        o.o_orderstatus as serial, o.o_orderpriority as payment, o.o_orderdate as issued,
        c.c_name as buyer, n.n_name as country, coalesce(s.n_lines, 0) as n_lines,
        s.sub_cents, s.vat_cents,
        case when o.o_orderkey % 4 = 0 then s.sub_cents + s.vat_cents
             when o.o_orderkey % 4 = 1 then s.sub_cents + s.vat_cents + 50
             when o.o_orderkey % 4 = 2 then s.sub_cents + s.vat_cents + 500 end as total_cents
      from orders o left join fx_sums s on o.o_orderkey = s.doc_key
      left join customer c on o.o_custkey = c.c_custkey left join nation n on c.c_nationkey = n.n_nationkey""")
    defs["fx_print"] = (("fx_head",), f"""
      select doc_key, document_id, serial, payment, buyer, country, n_lines, sub_cents, vat_cents, total_cents,
        {printed_money(d, "sub_cents")} as sub_text, {printed_money(d, "vat_cents")} as vat_text,
        {printed_money(d, "total_cents")} as total_text,
        case when doc_key % 2 = 0 then {printed_date("issued")} else {iso_date("issued")} end as date_text,
        {iso_date("issued")} as date_iso
      from fx_head""")
    # labelled entities: header on page 0, six item lines per page
    def cells(label: str, text: str, x: str, y: str, width: int) -> tuple[str, ...]:
        return (f"'{label}'", text, f"cast({x} as double)", f"cast({y} as double)",
                f"cast({x} + {width} as double)", f"cast({y} + 12 as double)")

    names = ("label", "text", "x_min", "y_min", "x_max", "y_max")
    header = [
        cells("B-INVOICE_NUMBER", "document_id", "50", "40", 200),
        cells("B-INVOICE_SERIAL", "serial", "50", "60", 200),
        cells("B-INVOICE_DATE", "date_text", "50", "80", 200),
        cells("B-PAYMENT_METHOD", "payment", "50", "100", 200),
        cells("B-SUBTOTAL", "sub_text", "50", "900", 200),
        cells("B-VAT_TOTAL", "vat_text", "50", "920", 200),
        cells("B-GRAND_TOTAL", "total_text", "50", "940", 200),
        cells("B-BUYER_ORGANIZATION", "substring(buyer, 1, 8)", "50", "120", 100),
        cells("I-BUYER_ORGANIZATION", "' ' || substring(buyer, 10, 20)", "160", "120", 100),
        cells("B-SUPPLIER_NAME", "case when doc_key % 6 <> 0 then country end", "50", "140", 100),
        cells("B-STATUS", "case when doc_key % 5 <> 0 then serial end", "400", "40", 50),
        cells("O", "case when doc_key % 3 = 0 then 'page note' end", "400", "60", 50),
    ]
    item_y = "200 + 20 * ((line_no - 1) % 6) + (line_no * 7 + doc_key + {k}) % 4"
    items = [
        ("LINE_NUMBER", "cast(line_no as string)", 50), ("MEDICINE_NAME", "p_name", 100),
        ("LOT_NUMBER", "'L' || lpad(cast(part_key as string), 6, '0')", 220),
        ("EXPIRY_DATE", printed_date("ship"), 300), ("QUANTITY", "cast(qty as string)", 380),
        ("UNIT_PRICE", printed_money(d, d.div("cents", "qty")), 440),
        ("LINE_AMOUNT", printed_money(d, "cents"), 540), ("ITEM_VAT_RATE", "cast(rate as string) || '%'", 640),
    ]
    lines = [cells(f"B-{label}", text, str(x), f"({item_y.format(k=k)})", 50) for k, (label, text, x) in enumerate(items)]
    defs["fx_item"] = (("fx_lines",), """
      select 'INV-' || lpad(cast(l.doc_key as string), 8, '0') as document_id, l.doc_key, l.line_no, l.part_key,
        l.qty, l.cents, l.rate, l.ship, l.flag, p.p_name from fx_lines l left join part p on l.part_key = p.p_partkey""")
    defs["fx_ent"] = (("fx_print", "fx_item"), f"""
      select * from ({d.unpivot("fx_print", "document_id, cast(0 as bigint) as page_index", names, header)}) where text is not null
      union all {d.unpivot("fx_item", f"document_id, {d.div('(line_no - 1)', '6')} as page_index", names, lines)}""")
    # printed tokens of whole documents: twelve to a line, forty lines to a page
    defs["fx_words"] = ((), d.words())
    defs["fx_tok"] = (("fx_words",), f"""
      select doc_key, cast(doc_key as string) as document_id, tok, word as text,
        {d.div("tok", "480")} as page_index, cast(doc_key as string) || '-' || lpad(cast(tok as string), 8, '0') as region_id,
        cast(60 * (tok % 12) as double) as x_min,
        cast(20 * ({d.div("tok", "12")} % 40) + (7 * doc_key + tok) % 5 + case when (doc_key + tok) % 11 = 0 then 6 else 0 end as double) as y_min,
        cast(60 * (tok % 12) + 10 + 5 * length(word) as double) as x_max,
        cast(20 * ({d.div("tok", "12")} % 40) + (7 * doc_key + tok) % 5 + case when (doc_key + tok) % 11 = 0 then 6 else 0 end + 12 as double) as y_max,
        cast((31 * doc_key + 7 * tok) % 100 as double) / 100 as confidence
      from fx_words""")
    # predicted and annotated boxes
    defs["fx_box_gt"] = (("fx_tok",), """
      select document_id, page_index, tok as box_index, x_min, y_min, x_max, y_max from fx_tok""")
    defs["fx_box_pred"] = (("fx_tok",), """
      select document_id, page_index, tok as box_index, x_min + 3 * (tok % 4) as x_min, y_min + (tok % 3) as y_min,
        x_max + 3 * (tok % 4) as x_max, y_max + (tok % 3) as y_max from fx_tok where tok % 11 <> 0
      union all
      select document_id, page_index, tok + 10000000, x_min + 700, y_min, x_max + 700, y_max from fx_tok where tok % 13 = 0
      union all
      select document_id, page_index, tok + 20000000, x_min + 2, y_min + 1, x_max + 1, y_max from fx_tok where tok % 17 = 0""")
    # transcriptions
    defs["fx_txt"] = ((), """
      select p_partkey as region_key, cast(p_partkey as string) as region_id,
        p_name || ' ' || lower(p_type) || case when p_partkey % 3 = 0 then '' else ' x' || cast(p_size as string) end as expected,
        case when p_partkey % 11 = 0 then null when p_partkey % 7 = 0 then lower(p_type)
             when p_partkey % 5 = 0 then replace(p_name, 'e', 'c') || ' ' || lower(p_type)
             else p_name || ' ' || lower(p_type) || case when p_partkey % 3 = 0 then '' else ' x' || cast(p_size as string) end end as predicted
      from part
      union all
      select p_partkey + 100000000, 'n' || cast(p_partkey as string), cast(p_size as string) || ',' || lpad(cast(p_partkey % 100 as string), 2, '0'),
        case when p_partkey % 9 = 0 then cast(p_size as string) else cast(p_size as string) || ',' || lpad(cast(p_partkey % 100 as string), 2, '0') end
      from part""")
    # flattened records, annotated and predicted
    fields = [
        ("document_type", "string", "'VAT_INVOICE_BATCH'"),
        ("invoice_count", "number", "'1'"),
        ("invoices[0].page_number", "number", "'1'"),
        ("invoices[0].invoice.invoice_number", "string", "document_id"),
        ("invoices[0].invoice.invoice_date", "string", "date_iso"),
        ("invoices[0].invoice.invoice_serial", "string", "serial"),
        ("invoices[0].invoice.payment_method", "string", "payment"),
        ("invoices[0].buyer.buyer_organization", "string", "buyer"),
        ("invoices[0].supplier.supplier_name", "string", "country"),
        ("invoices[0].totals.subtotal_excluding_vat", "number", plain_money(d, "sub_cents")),
        ("invoices[0].totals.vat_total", "number", plain_money(d, "vat_cents")),
        ("invoices[0].totals.grand_total", "number", plain_money(d, "total_cents")),
        ("invoices[0].workflow_fields.status.value", "string", "serial"),
        ("invoices[0].workflow_fields.status.source", "string", "'invoice'"),
        ("invoices[0].validation.item_count", "number", "cast(n_lines as string)"),
    ]
    def typed(path: str, kind: str, value: str) -> tuple[str, ...]:
        return (path, f"case when {value} is null then 'null' else '{kind}' end", value)

    item_fields = [
        ("line_number", "number", "cast(line_no as string)"), ("medicine_name", "string", "p_name"),
        ("lot_number", "string", "'L' || lpad(cast(part_key as string), 6, '0')"),
        ("quantity", "number", "cast(qty as string)"), ("line_amount", "number", plain_money(d, "cents")),
    ]
    head_rows = [typed(f"'{path}'", kind, value) for path, kind, value in fields]
    item_rows = [
        typed(f"'invoices[0].items[' || cast(line_no - 1 as string) || '].{name}'", kind, value)
        for name, kind, value in item_fields
    ]
    record = ("path", "kind", "text")
    defs["fx_gt"] = (("fx_print", "fx_item"), f"""
      {d.unpivot("fx_print", "doc_key, document_id", record, head_rows)}
      union all {d.unpivot("fx_item", "doc_key, document_id", record, item_rows)}""")
    defs["fx_pred"] = (("fx_gt",), """
      select doc_key, document_id, path, kind,
        case when path like '%payment_method' and doc_key % 5 = 0 then '9-OTHER'
             when path like '%invoice_serial' and doc_key % 7 = 0 then lower(text)
             when path like '%.medicine_name' and doc_key % 7 = 0 then upper(text)
             when path like '%.quantity' and doc_key % 8 = 0 then '99' else text end as text
      from fx_gt where doc_key % 17 <> 0 and not (path like '%buyer_organization' and doc_key % 10 = 0)
      union all
      select doc_key, document_id, 'invoices[0].invoice.contract_reference', 'string', 'HD-' || cast(doc_key as string)
      from fx_print where doc_key % 9 = 0 and doc_key % 17 <> 0
      union all
      select doc_key, 'EXTRA-' || cast(doc_key as string), 'invoices[0].invoice.invoice_number', 'string', document_id
      from fx_print where doc_key % 50 = 0""")
    # item rows, annotated and predicted (predicted rows come in reverse order for some documents)
    defs["fx_items_gt"] = (("fx_item",), f"""
      select document_id, doc_key, line_no - 1 as item_index, p_name as medicine_name,
        'L' || lpad(cast(part_key as string), 6, '0') as lot_number, cast(qty as string) as quantity,
        {plain_money(d, "cents")} as line_amount from fx_item""")
    defs["fx_items_pred"] = (("fx_items_gt",), """
      select document_id, doc_key,
        case when doc_key % 4 = 0 then count(*) over (partition by document_id) - 1 - item_index else item_index end as item_index,
        case when doc_key % 7 = 0 then upper(medicine_name) else medicine_name end as medicine_name,
        case when item_index % 3 = 2 and doc_key % 3 = 0 then 'L999999' else lot_number end as lot_number,
        case when doc_key % 8 = 0 then '99' else quantity end as quantity, line_amount
      from fx_items_gt where doc_key % 17 <> 0""")
    # known values and recognised regions of printed documents
    field = ("ord", "field_path", "label", "normalization_kind", "gt_value", "item_index", "line_number")

    def known(order: str, path: str, label: str, kind: str, value: str, item: str, line: str) -> tuple[str, ...]:
        return (f"cast({order} as bigint)", path, f"'{label}'", f"'{kind}'", value, f"cast({item} as bigint)", f"cast({line} as bigint)")

    head_fields = [
        known("1", "'invoices[0].invoice.invoice_number'", "INVOICE_NUMBER", "identifier", "document_id", "null", "null"),
        known("2", "'invoices[0].invoice.invoice_date'", "INVOICE_DATE", "date", "date_iso", "null", "null"),
        known("3", "'invoices[0].buyer.buyer_organization'", "BUYER_ORGANIZATION", "text", "'Customer ' || substring(buyer, 10, 20)", "null", "null"),
        known("4", "'invoices[0].totals.subtotal_excluding_vat'", "SUBTOTAL", "money", plain_money(d, "sub_cents"), "null", "null"),
        known("5", "'invoices[0].totals.grand_total'", "GRAND_TOTAL", "money", plain_money(d, "total_cents"), "null", "null"),
    ]
    item_path = "'invoices[0].items[' || cast(line_no - 1 as string) || '].{n}'"
    item_known = [
        known(f"10 + 3 * line_no + {k}", item_path.format(n=n), label, kind, value, "line_no - 1", "line_no")
        for k, (n, label, kind, value) in enumerate((
            ("medicine_name", "MEDICINE_NAME", "text", "p_name"), ("quantity", "QUANTITY", "number", "cast(qty as string)"),
            ("line_amount", "LINE_AMOUNT", "money", plain_money(d, "cents"))))
    ]
    defs["fx_fields"] = (("fx_print", "fx_item"), f"""
      select * from ({d.unpivot("fx_print", "document_id, doc_key, cast(0 as bigint) as page_index, cast(0 as bigint) as invoice_index", field, head_fields)}) where gt_value is not null
      union all {d.unpivot("fx_item", f"document_id, doc_key, {d.div('(line_no - 1)', '6')} as page_index, cast(0 as bigint) as invoice_index", field, item_known)}""")
    seen = ("ord", "region_id", "text", "x_min", "y_min", "x_max", "y_max")

    def printed(order: str, name: str, text: str, x: str, y: str, width: int) -> tuple[str, ...]:
        return (f"cast({order} as bigint)", f"document_id || {name}", text, f"cast({x} as double)", f"cast({y} as double)",
                f"cast({x} + {width} as double)", f"cast({y} + 12 as double)")

    whole = "'Customer ' || substring(buyer, 10, 20)"
    head_regions = [
        printed("1", "'-num'", "'Số: ' || document_id", "50", "40", 200),
        printed("2", "'-again'", "case when doc_key % 4 = 0 then document_id end", "50", "60", 200),
        printed("3", "'-date'", "date_text", "50", "80", 200),
        printed("4", "'-who'", f"case when doc_key % 3 = 0 then 'Customer' when doc_key % 5 = 0 then 'Custmer ' || substring(buyer, 10, 20) when doc_key % 2 = 1 then upper({whole}) else {whole} end", "50", "120", 90),
        printed("5", "'-whom'", "case when doc_key % 3 = 0 then substring(buyer, 10, 20) end", "150", "120", 90),
        printed("6", "'-sub'", "'Tong tien hang: ' || sub_text", "50", "900", 200),
        printed("7", "'-total'", "total_text || ' VND'", "50", "940", 200),
        printed("8", "'-note'", "case when doc_key % 7 = 0 then ' ' else 'page note' end", "400", "60", 60),
    ]
    at = "200 + 20 * ((line_no - 1) % 6) + (line_no * 7 + doc_key + {k}) % 4"
    item_regions = [
        printed(f"10 + 3 * line_no + {k}", f"'-{n}' || cast(line_no as string)", text, str(x), f"({at.format(k=k)})", 60)
        for k, (n, text, x) in enumerate((("name", "p_name", 100), ("qty", "cast(qty as string)", 380), ("amount", printed_money(d, "cents"), 540)))
    ]
    defs["fx_regions"] = (("fx_print", "fx_item"), f"""
      select *, cast(60 + (31 * doc_key + 7 * ord) % 40 as double) / 100 as detection_confidence, cast(70 + (13 * doc_key + 11 * ord) % 30 as double) / 100 as recognition_confidence
      from (select * from ({d.unpivot("fx_print", "document_id, doc_key, cast(0 as bigint) as page_index", seen, head_regions)}) where text is not null
        union all {d.unpivot("fx_item", f"document_id, doc_key, {d.div('(line_no - 1)', '6')} as page_index", seen, item_regions)})""")
    # finished alignments in every quality, and the tokens they refer to
    mix = "(31 * doc_key + 17 * ord)"
    own, after = "document_id || '-r' || cast(ord as string)", "document_id || '-r' || cast(ord + 1 as string)"
    defs["fx_align"] = (("fx_fields",), f"""
      select document_id, doc_key, ord, field_path, label, gt_value, page_index,
        case when {mix} % 5 = 0 then lower(gt_value) || 'x' else gt_value end as ocr_text, page_index + 1 as page,
        case {mix} % 7 when 0 then 'exact' when 1 then 'exact_normalized' when 2 then 'fuzzy' when 3 then 'multi_box_exact' when 4 then 'money_normalized' when 5 then 'value_substring' else 'whitespace_normalized' end as match_method,
        cast(case when {mix} % 7 in (2, 5) then 86 when {mix} % 19 = 0 then 97 else 99 end as double) / 100 as match_confidence,
        cast(75 + {mix} % 25 as double) / 100 as recognition_confidence, cast(78 + {mix} % 22 as double) / 100 as detection_confidence,
        {mix} % 7 in (2, 5) as ambiguous, {mix} % 23 = 0 as duplicate_candidates, case when {mix} % 23 = 0 then cast(2 as bigint) else cast(1 as bigint) end as candidate_count,
        {mix} % 7 not in (2, 5) as training_eligible,
        case when {mix} % 53 = 0 then {d.array(own, own)} when {mix} % 7 = 3 then {d.array(own, after)} else {d.array(own)} end as region_ids
      from fx_fields where {mix} % 11 <> 0""")
    defs["fx_align_tokens"] = (("fx_fields",), f"""
      select document_id, doc_key, page_index, ord, {own} as region_id, gt_value as token from fx_fields where {mix} % 37 <> 0""")
    # source files and annotation files
    defs["fx_source"] = ((), f"""
      select doc_id as doc_key, 'Scan_' || source || '/' || lang || '/' || case when doc_id % 10 = 0 then 'page' || cast({d.div("doc_id", "20")} as string)
        else 'doc' || cast(doc_id as string) end || '.PDF' as relative_path,
        {d.sha256("text")} as sha256, n_chars from documents""")
    defs["fx_files"] = (("fx_source",), f"""
      select case when doc_key % 6 = 0 then 'batch7/moved/' else 'batch7/' || substring(relative_path, 1, length(relative_path) - length(
          case when doc_key % 10 = 0 then 'page' || cast({d.div("doc_key", "20")} as string) else 'doc' || cast(doc_key as string) end) - 4) end
        || case when doc_key % 10 = 0 then 'page' || cast({d.div("doc_key", "20")} as string) else 'doc' || cast(doc_key as string) end || '.json' as gt_path,
        {d.sha256("'gt' || cast(doc_key as string)")} as gt_sha256
      from fx_source where doc_key % 13 <> 0
      union all
      select 'other/extra' || cast(doc_key as string) || '.json', {d.sha256("'x' || cast(doc_key as string)")} from fx_source where doc_key % 12 = 1
      union all
      select 'splits/locked' || cast(doc_key as string) || '.json', {d.sha256("'s' || cast(doc_key as string)")} from fx_source where doc_key % 40 = 1""")
    # evaluation runs: events before and after the middle of the month
    for side, test in (("before", "<"), ("after", ">=")):
        defs[f"fx_run_{side}"] = ((), f"""
          select event_type || case when event_type in ('click', 'view') then '_accuracy' when event_type = 'error' then '_failed' else '_time' end as metric,
            cast(sum(cast(round(value * 100) as bigint)) as bigint) / (count(*) * 100.0e0) as value
          from events where ts {test} timestamp '2024-01-16 00:00:00' group by event_type
          union all select '{side}_only_score', 1.0e0 union all select 'stable_f1', 0.5e0
          union all select 'character_error_rate', case when '{side}' = 'before' then 0.5e0 else 0.4e0 end
          union all select 'zero_recall', case when '{side}' = 'before' then 0.0e0 else 0.25e0 end""")
        defs[f"fx_docs_{side}"] = ((), f"""
          select cast(user_id as string) as document_id, cast(sum(cast(round(value * 100) as bigint)) as bigint) / (count(*) * 100.0e0) as value
          from events where ts {test} timestamp '2024-01-16 00:00:00' group by user_id""")
        defs[f"fx_fields_{side}"] = ((), f"""
          select 'k' || props as field, count_if(value > 20) / (count(*) * 1.0e0) as value
          from events where ts {test} timestamp '2024-01-16 00:00:00' group by props""")
    defs["fx_times"] = ((), """
      select 'd' || cast(user_id as string) as document_id, event_type as stage, value as seconds, event_id,
        cast(round(value * 1000) as bigint) as millis,
        case when event_type = 'error' then 'failed' when event_id % 10 = 0 then 'skipped' else 'success' end as status,
        'run' || cast(user_id % 12 as string) as run_id, event_id % 5 as stage_order
      from events""")
    return defs


def _with_needed(defs, names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in defs[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def oracle(body: str, *names: str) -> str:
    """DuckDB text: the named fixtures as CTEs, then ``body`` (which may start with more CTEs)."""
    defs = _definitions(Dialect("duckdb"))
    parts = [f"{name} as ({defs[name][1]})" for name in _with_needed(defs, names)]
    text = body.strip()
    recursive = ""
    if text.lower().startswith("with recursive "):
        recursive, text = "recursive ", text[15:]
        more = ", " if parts else ""
        return f"with recursive {', '.join(parts)}{more}{text}"
    if text.lower().startswith("with "):
        text = text[5:]
        return f"with {', '.join(parts)}{', ' if parts else ''}{text}"
    return f"with {', '.join(parts)} {text}" if parts else text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.

    A table of one row group is one task, whatever its rows turn into; where a scan has fewer tasks
    than the session has cores its rows are dealt out first. Large tables are left as they are read.
    """
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in SMALL or read._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return read
    return read.repartition(cores)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    defs = _definitions(Dialect("spark"))
    text = ", ".join(f"{needed} as ({defs[needed][1]})" for needed in _with_needed(defs, (name,)))
    for needed in TABLES:
        if re.search(rf"\b{needed}\b", text):
            table(spark, sf_dir, needed).createOrReplaceTempView(needed)
    return spark.sql(f"with {text} select * from {name}")
