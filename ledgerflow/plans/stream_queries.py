"""Registered streaming queries (O-80..O-82).

Each feeds rows derived from the test tables into a file source folder, runs
the streaming query with ``availableNow`` (restarting it from its checkpoint
for every new chunk), and returns what the sink holds. The oracles are the
batch ones: a stream must end with the same rows as the batch operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow import streaming as st
from ledgerflow.operators import approvals as ap
from ledgerflow.plans.approval_queries import _AUDIT_SELECT, _INVOICE_BASE, _INVOICE_VIEWS, _REPLAY_VIEWS, _REPLAYS
from ledgerflow.plans.chat_queries import PARSE_COMMANDS_SQL
from ledgerflow.plans.registry import register
from ledgerflow.session import materialize, work_dir
from ledgerflow.sources.audit import AUDIT_COLUMNS, append_audit, read_audit


def _time_chunks(df: DataFrame, col: str, n: int) -> list[DataFrame]:
    """Split rows into ``n`` consecutive time ranges (bounds from one min/max aggregate); rows without a time
    come in the first."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    if lo is None:
        return [df]
    step = (hi - lo) / n
    bounds = [lo + step * i for i in range(1, n)]
    out, prev = [], None
    def ts(x):
        return F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")

    for b in bounds:
        cond = F.col(col) < ts(b)
        out.append(df.filter((cond | F.col(col).isNull()) if prev is None else cond & (F.col(col) >= ts(prev))))
        prev = b
    out.append(df.filter(F.col(col) >= ts(prev)) if prev is not None else df)
    return out


def _run_chunks(chunks: list[DataFrame], feed: str, start) -> None:
    for chunk in chunks:
        chunk.write.mode("append").parquet(feed)
        st.drain(start())


@register("stream_invoice_approvals", _INVOICE_VIEWS, _INVOICE_BASE + "\nSELECT * FROM res")
def stream_invoice_approvals(fx):
    """O-81: invoice approval requests arriving as a stream in three time-ordered chunks; each
    micro-batch folds against the states earlier batches left. Ends equal to the batch fold."""
    spark = fx.spark
    root = work_dir(spark, "streams", uuid.uuid4().hex)
    feed, outcomes, states, ckpt = (f"{root}/{x}" for x in ("feed", "outcomes", "states", "ckpt"))
    requests = fx["approval_request"]
    schema = requests.schema

    def start():
        src = spark.readStream.schema(schema).parquet(feed)
        return st.approval_stream(src, lambda: fx["account_move"], "invoice", outcomes, states, ckpt,
                                  partners=lambda: fx["res_partner"])

    _run_chunks(_time_chunks(requests, "requested_at", 3), feed, start)
    return spark.read.parquet(outcomes).drop("batch_id")


def replayed_approvals(fx, chunks: int) -> DataFrame:
    """Outcomes of the requests with repeats, streamed in ``chunks`` time ranges; each chunk after the first comes
    with all requests of the first once more (late, and replays)."""
    spark = fx.spark
    root = work_dir(spark, "streams", uuid.uuid4().hex)
    feed, outcomes, states, ckpt = (f"{root}/{x}" for x in ("feed", "outcomes", "states", "ckpt"))
    requests = fx["approval_request_replays"]
    schema = requests.schema

    def start():
        src = spark.readStream.schema(schema).parquet(feed)
        return st.approval_stream(src, lambda: fx["account_move"], "invoice", outcomes, states, ckpt,
                                  partners=lambda: fx["res_partner"])

    parts = _time_chunks(requests, "requested_at", chunks)
    _run_chunks([parts[0], *(p.unionByName(parts[0]) for p in parts[1:])], feed, start)
    return spark.read.parquet(outcomes).drop("batch_id")


@register("stream_approvals_replays", _REPLAY_VIEWS, _REPLAYS + "\nSELECT * FROM res")
def stream_approvals_replays(fx):
    """O-81: requests that repeat inside a batch and in later batches; each has one outcome."""
    return replayed_approvals(fx, 2)


@register("audit_stream_then_append", _INVOICE_VIEWS, _INVOICE_BASE + _AUDIT_SELECT.format(
    meta="CASE WHEN reason IS NOT NULL AND reason <> '' THEN CAST(to_json(struct_pack(reason := reason)) AS VARCHAR) END"))
def audit_stream_then_append(fx):
    """O-80, O-04: half of the audit rows streamed, then all of them appended by a batch: each is stored once."""
    spark = fx.spark
    root = work_dir(spark, "streams", uuid.uuid4().hex)
    feed, sink, ckpt = f"{root}/feed", f"{root}/audit", f"{root}/ckpt"
    outcomes = materialize(ap.apply_approvals(fx["approval_request"], fx["account_move"], "invoice", fx["res_partner"]))
    first = _time_chunks(outcomes, "requested_at", 2)[0]
    _run_chunks([first], feed, lambda: st.audit_stream(
        spark.readStream.schema(outcomes.schema).parquet(feed), sink, ckpt))
    append_audit(ap.audit_rows(outcomes), sink)
    return read_audit(spark, sink).select(*AUDIT_COLUMNS)


@register("stream_audit_rows", _INVOICE_VIEWS, _INVOICE_BASE + _AUDIT_SELECT.format(
    meta="CASE WHEN reason IS NOT NULL AND reason <> '' THEN CAST(to_json(struct_pack(reason := reason)) AS VARCHAR) END"))
def stream_audit_rows(fx):
    """O-80: approval outcomes streamed into the partitioned audit table."""
    spark = fx.spark
    root = work_dir(spark, "streams", uuid.uuid4().hex)
    feed, sink, ckpt = f"{root}/feed", f"{root}/audit", f"{root}/ckpt"
    # The outcomes feed the stream in two time slices: fold them once, not once per slice.
    outcomes = materialize(ap.apply_approvals(fx["approval_request"], fx["account_move"], "invoice",
                                              fx["res_partner"]))
    schema = outcomes.schema

    def start():
        return st.audit_stream(spark.readStream.schema(schema).parquet(feed), sink, ckpt)

    _run_chunks(_time_chunks(outcomes, "requested_at", 2), feed, start)
    return spark.read.parquet(sink).select(*AUDIT_COLUMNS)


@register("stream_parse_commands", ["command_log"], PARSE_COMMANDS_SQL)
def stream_parse_commands(fx):
    """O-82: the chat command log parsed as a stream (stateless, same rows as the batch parse)."""
    spark = fx.spark
    root = work_dir(spark, "streams", uuid.uuid4().hex)
    feed, sink, ckpt = f"{root}/feed", f"{root}/commands", f"{root}/ckpt"
    log = fx["command_log"]
    schema = log.schema

    def start():
        return st.command_stream(spark.readStream.schema(schema).parquet(feed), sink, ckpt)

    half = log.agg(F.percentile_approx("conv_id", 0.5)).first()[0]
    early = F.coalesce(F.col("conv_id") <= half, F.lit(True))  # rows without a conversation come first
    _run_chunks([log.filter(early), log.filter(~early)], feed, start)
    return spark.read.parquet(sink)
