"""The knowledge base: ingest sources, answer questions in batches.

Each tier answers what the ones before it left: the cache, then patterns and
walks through the facts, then one fact that matches alone, and at last a
language model over a ranked fact set. A question is a row all the way.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.config import Config
from quillgraph.functions import text as tx
from quillgraph.operators import assemble, bm25, evaluate, extract, graph, resolve, resolver, store, synth
from quillgraph.prompts import prompt
from quillgraph.providers import Provider, provider
from quillgraph.session import materialise
from quillgraph.sources import loaders

NO_ANSWER = "Insufficient knowledge to answer."
ANSWER_COLUMNS = ["qid", "answer", "fact_ids", "trace", "confidence", "tokens_used", "tier"]


def parse_subquestions(response: str | None, limit: int) -> list[str]:
    """A JSON array, or lines that look like questions, or what commas or "and" part."""
    text = re.sub(r"^`{3}(?:json)?\s*|`{3}\s*$", "", (response or "").strip()).strip()
    try:
        listed = json.loads(text)
    except ValueError:
        listed = None
    if isinstance(listed, list):
        return [x for x in (str(i).strip() for i in listed) if x][:limit]
    lines = [re.sub(r'^\d+[.)]\s*|^"\s*|\s*"$', "", x.strip()) for x in re.split(r"[\r\n]+", text)]
    found = [x for x in lines if "?" in x or len(x) > 10]
    if not found and text:
        found = text.split(",") if "," in text else re.split(r"\s+and\s+", text, maxsplit=4)
    return [x.strip() for x in found if x.strip()][:limit]


class KnowledgeBase:
    def __init__(self, spark: SparkSession, config: Config | None = None, model: Provider | None = None) -> None:
        self.spark, self.config = spark, config or Config()
        self.store = store.Store(spark, self.config.kb_dir)
        self.model = model if model is not None else provider(self.config.provider, self.config.model)

    # Ingestion

    def ingest(self, source, fetch=None) -> dict[str, int]:
        """Load, deduplicate, chunk, extract, resolve and store; counts of what came in and what was known."""
        segments = loaders.load(self.spark, source, fetch)
        return self.ingest_segments(segments)

    def chunk(self, segments: DataFrame) -> DataFrame:
        """``doc_id, source, chunk_index, content`` of segments with new content; blank ones and repeats drop out."""
        s = segments.where(F.coalesce(F.trim("content"), F.lit("")) != "").withColumn("hash", tx.content_hash(F.col("content")))
        first = s.withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy("source", "seq"))).where("n = 1")
        parts = first.select("source", "seq", F.posexplode(tx.chunks(F.col("content"), self.config.chunk_tokens)).alias("part", "content"))
        order = Window.partitionBy("source").orderBy("seq", "part")
        return parts.select(F.substring(F.sha2("source", 256), 1, 16).alias("doc_id"), "source", (F.row_number().over(order) - 1).alias("chunk_index"), "content")

    def ingest_segments(self, segments: DataFrame) -> dict[str, int]:
        documents = segments.groupBy("source").agg(F.min("doc_type").alias("doc_type"), F.sum(F.length("content")).alias("char_count"), F.xxhash64(F.array_sort(F.collect_list(F.xxhash64("content")))).alias("h"))
        documents = documents.select(F.substring(F.sha2(F.concat_ws("|", "source", F.col("h").cast("string")), 256), 1, 16).alias("id"), F.col("source").alias("path"), "doc_type", F.current_timestamp().alias("ingested_at"), "char_count", F.create_map().cast("map<string,string>").alias("metadata"))
        old_docs, old_facts, old_entities = (self.store.read(t) for t in ("documents", "facts", "entities"))
        fresh = materialise(store.new_documents(documents, old_docs, old_facts), "documents")
        new = segments.join(fresh.select(F.col("path").alias("source")), "source", "left_semi")
        skipped, n = documents.count(), fresh.count()
        if n == 0 or self.model is None:
            raw = self.spark.createDataFrame([], "doc_id string, source string, chunk_index int, pos int, subject string, predicate string, object string, object_value string, context string, confidence double")
        else:
            raw = extract.extract(self.chunk(new), self.model.complete, prompt("extract"), self.config.concurrency)
        raw = materialise(extract.cap(raw.withColumn("segment", F.concat_ws("#", "doc_id", "chunk_index")), "segment", self.config.fact_confidence_threshold, self.config.max_facts_per_segment), "raw")
        facts, entities = self.attach(raw, old_entities)
        added = self.add(facts, entities, fresh)
        return {"documents": n, "skipped": skipped - n, **added}

    def attach(self, raw: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Raw facts with the ids of their entities, and the entities that are new or have new aliases."""
        mentions = raw.select(F.col("subject").alias("mention")).union(raw.where("object IS NOT NULL").select("object"))
        found = materialise(resolve.resolve(mentions, entities, self.config.fuzzy_threshold), "mentions")
        now = F.current_timestamp()
        new = found.where("how = 'new'").select(F.col("entity_id").alias("id"), F.col("mention").alias("name"), F.lit(None).cast("string").alias("entity_type"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("description"), now.alias("created_at"))
        known = resolve.add_aliases(entities, found)
        s = found.select(F.col("mention").alias("subject"), F.col("entity_id").alias("subject_id"))
        o = found.select(F.col("mention").alias("object"), F.col("entity_id").alias("object_id"))
        f = raw.join(s, "subject").join(o, "object", "left")
        fact_id = F.concat(F.lit("f:"), F.substring(F.sha2(F.concat_ws("\u0001", "source", F.col("chunk_index").cast("string"), F.col("pos").cast("string"), "subject", "predicate", F.coalesce("object", F.lit("")), F.coalesce("object_value", F.lit(""))), 256), 1, 20))
        none = F.lit(None)
        facts = f.select(fact_id.alias("id"), "subject_id", "predicate", "object_id", "object_value", "context", F.col("source").alias("source_doc"), none.cast("int").alias("source_page"), "confidence", now.alias("ingested_at"), none.cast("timestamp").alias("valid_from"), none.cast("timestamp").alias("valid_until"), F.lit(True).alias("is_active"))
        return facts, known.unionByName(new)

    def add(self, facts: DataFrame, entities: DataFrame, documents: DataFrame | None = None) -> dict[str, int]:
        """Store facts, all entities and documents; each table is replaced as a whole version."""
        n_facts, before = facts.count(), self.store.read("entities").count()
        if documents is not None:
            self.store.write("documents", store.upsert(self.store.read("documents"), documents, ["id"]))
        self.store.write("entities", entities)
        self.store.write("facts", store.upsert(self.store.read("facts"), facts, ["id"]))
        return {"facts": n_facts, "entities": self.store.read("entities").count() - before}

    # Questions

    def version(self) -> str:
        return self.store.version("facts") or "empty"

    def ask(self, questions: DataFrame, at: str | None = None) -> DataFrame:
        """``qid, answer, fact_ids, trace, confidence, tokens_used, tier`` for ``qid, text``, one row each."""
        c = self.config
        q = materialise(questions.select("qid", F.coalesce("text", F.lit("")).alias("text")), "questions")
        key = store.cache_key(F.col("text"), F.lit(c.hop_depth), F.lit(c.min_confidence), F.lit(at), F.lit(c.top_seeds), F.lit(self.version()))
        keyed = q.withColumn("query_hash", key)
        parts = []
        if c.query_cache:
            hit = store.cached(self.store.read("query_cache"), keyed.select("qid", "query_hash"), F.current_timestamp())
            known = F.from_json("reasoning", "struct<fact_ids:array<string>,trace:array<string>>")
            parts.append(materialise(hit.select("qid", "answer", known["fact_ids"].alias("fact_ids"), known["trace"].alias("trace"), "confidence", F.lit(0).cast("long").alias("tokens_used"), F.lit("cache").alias("tier")), "cached"))
        facts, entities = self.store.read("facts"), self.store.read("entities")
        facts = facts.where("is_active")
        if at is not None:
            facts = store.as_of(facts, None, F.lit(at).cast("timestamp"))
        left = lambda: q.join(parts[-1].select("qid"), "qid", "left_anti") if len(parts) == 1 else self._left(q, parts)
        walked = resolver.resolve_questions(left() if parts else q, facts, entities, c.min_confidence)
        parts.append(materialise(walked.withColumns({"tokens_used": F.lit(0).cast("long"), "tier": F.lit("walk")}).select(*ANSWER_COLUMNS), "walked"))
        rest = materialise(self._left(q, parts), "rest")
        lines = materialise(self.evidence(rest, facts, entities), "lines")
        direct = synth.direct_answers(lines, rest)
        parts.append(materialise(direct.select("qid", "answer", F.array("fact_id").alias("fact_ids"), F.array(F.lit("one fact matches in subject and predicate")).alias("trace"), "confidence", F.lit(0).cast("long").alias("tokens_used"), F.lit("direct").alias("tier")), "direct"))
        if self.model is not None:
            parts.append(materialise(self._synthesize(self._left(q, parts), lines), "synthesized"))
        none = F.array().cast("array<string>")
        unanswered = self._left(q, parts).select("qid", F.lit(NO_ANSWER).alias("answer"), none.alias("fact_ids"), none.alias("trace"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("tokens_used"), F.lit("none").alias("tier"))
        out = unanswered
        for p in parts:
            out = out.unionByName(p)
        out = materialise(out, "answers")
        if c.query_cache:
            reasoning = F.to_json(F.struct("fact_ids", "trace"))
            new = out.where("tier NOT IN ('cache', 'none')").join(keyed, "qid").select("query_hash", F.col("text").alias("query_text"), "answer", reasoning.alias("reasoning"), "confidence", F.lit(self.version()).alias("kb_version"), F.current_timestamp().alias("created_at"), F.lit(c.query_cache_ttl).cast("long").alias("ttl_seconds")).dropDuplicates(["query_hash"])
            self.store.write("query_cache", store.upsert(self.store.read("query_cache"), new, ["query_hash"]))
        return out

    @staticmethod
    def _left(q: DataFrame, parts: list[DataFrame]) -> DataFrame:
        for p in parts:
            q = q.join(p.select("qid"), "qid", "left_anti")
        return q

    def subquestions(self, questions: DataFrame) -> DataFrame:
        """``qid, part, text``: split at question marks, by the model if a question is not simple, else whole."""
        several = tx.question_marks(F.col("text")) >= 2
        split = questions.select("qid", F.posexplode(F.when(several, tx.split_questions(F.col("text"))).otherwise(F.array("text"))).alias("part", "text"))
        if self.model is None:
            return split
        model, limit, ask = self.model, self.config.max_subquestions, prompt("decompose").replace("{n}", str(self.config.max_subquestions))
        kind = questions.schema["qid"].dataType.simpleString()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                rows = []
                for qid, text in zip(pdf["qid"], pdf["text"], strict=True):
                    found = parse_subquestions(model.complete([{"role": "system", "content": ask}, {"role": "user", "content": text}]), limit)
                    rows += [(qid, i, x) for i, x in enumerate(found if len(found) > 1 else [text])]
                yield pd.DataFrame(rows, columns=["qid", "part", "text"])

        simple = tx.looks_simple(F.col("text"))
        hard = questions.where(~simple & (F.trim("text") != "")).select("qid", "text").mapInPandas(run, f"qid {kind}, part int, text string")
        return split.join(hard.select("qid").distinct(), "qid", "left_anti").unionByName(hard)

    def evidence(self, questions: DataFrame, facts: DataFrame, entities: DataFrame) -> DataFrame:
        """The ranked and budgeted facts of each question, by way of seeds and their surroundings."""
        c = self.config
        parts = materialise(self.subquestions(questions), "parts")
        cleaned = F.regexp_replace("text", "[?.,!;:]", " ")
        numbered = parts.select(F.struct("qid", "part").alias("qid"), cleaned.alias("text"))
        hits = bm25.search_entities(entities, numbered, c.top_seeds).select("qid.qid", "qid.part", "id", "rank")
        seeds = bm25.fuse_seeds(hits, entities, c.top_seeds, c.max_seeds)
        e = graph.edges(facts)
        around = graph.bfs(graph.both_ways(e), seeds.select("qid", F.col("id").alias("node")), c.hop_depth, ["qid"])
        near = Window.partitionBy("qid").orderBy("depth", "node")
        nodes = around.withColumn("n", F.row_number().over(near)).where(F.col("n") <= c.max_subgraph_nodes).select("qid", "node")
        # Facts of the nodes themselves: literal facts of a seed count even where it has no edge.
        mine = nodes.select("qid", F.col("node").alias("subject_id")).join(facts, "subject_id").select("qid", *facts.columns)
        kept = assemble.dedup(store.active(mine, c.min_confidence), ["qid"])
        return assemble.trim(assemble.rank(store.with_names(kept, entities), questions, assemble.most_lines(c.token_budget)), c.token_budget)

    def _synthesize(self, questions: DataFrame, lines: DataFrame) -> DataFrame:
        """One call for each question that has facts; labels become fact ids, and the answer is scored against the facts."""
        kept = synth.filter_facts(lines, questions)
        order = F.array_sort(F.collect_list(F.struct("rank", "line", "id")))
        per = kept.groupBy("qid").agg(order.alias("facts")).join(questions, "qid")
        model, ask, limits, temperature = self.model, prompt("synthesize"), synth.TASK_TOKENS, self.config.temperature
        task = tx.classify_task(F.col("text"))
        kind = questions.schema["qid"].dataType.simpleString()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                rows = []
                for qid, text, body, kind_of in pdf[["qid", "text", "body", "task"]].itertuples(index=False):
                    messages = [{"role": "system", "content": ask}, {"role": "user", "content": f"Facts:\n{body}\n\nQuestion: {text}"}]
                    said = model.complete(messages, temperature=temperature, max_tokens=limits[kind_of])
                    if not said or not said.strip():
                        said = model.complete(messages, temperature=temperature, max_tokens=2 * limits[kind_of])
                    rows.append((qid, said))
                yield pd.DataFrame(rows, columns=["qid", "response"])

        body = F.array_join(F.transform("facts", lambda x: x["line"]), "\n")
        said = materialise(per.select("qid", "text", body.alias("body"), task.alias("task")).mapInPandas(run, f"qid {kind}, response string"), "responses")
        parsed = synth.parse_responses(said).where("answer IS NOT NULL").withColumn("answer", tx.strip_labels(F.col("answer")))
        ids = F.transform(F.filter("facts", lambda x: F.array_contains("labels", F.concat(F.lit("F"), x["rank"].cast("string")))), lambda x: x["id"])
        answers = parsed.join(per, "qid").select("qid", "answer", ids.alias("fact_ids"), F.transform(ids, lambda i: F.concat(F.lit("cited "), i)).alias("trace"), F.col("text").alias("question"))
        if "context" not in kept.columns:
            kept = kept.withColumn("context", F.lit(""))
        sure = synth.confidence(kept, answers.select("qid", "question", "answer"))
        tokens = synth.tokens_used(kept, questions, len(ask))
        return answers.join(sure, "qid").join(tokens, "qid").select("qid", "answer", "fact_ids", "trace", "confidence", F.col("tokens").alias("tokens_used"), F.lit("model").alias("tier"))

    def query(self, text: str, at: str | None = None) -> dict:
        """One question, as a batch of one."""
        row = self.ask(self.spark.createDataFrame([(0, text)], "qid long, text string"), at).first()
        return {k: v for k, v in row.asDict().items() if k != "qid"}

    def stream(self, text: str) -> Iterator[str]:
        """Words of an answer as they come: from the model where it has a say, else from the tiers before it."""
        found = self.query(text)
        yield from found["answer"].split(" ")

    def stats(self) -> dict[str, int]:
        facts = self.store.read("facts")
        rows = store.stats(documents=self.store.read("documents"), entities=self.store.read("entities"), facts=facts, relationships=facts.where("object_id IS NOT NULL")).collect()
        return {r["name"]: r["n"] for r in rows}

    def evaluate(self, cases: DataFrame) -> DataFrame:
        """The report on ``qid, text, expected, expected_entities``."""
        got = self.ask(cases.select("qid", "text"))
        named = store.with_names(self.store.read("facts"), self.store.read("entities"))
        cited = got.select("qid", F.explode("fact_ids").alias("id")).join(named, "id").groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "subject_name", "predicate", "object_value", "object_name"))), " ").alias("cited"))
        rows = cases.join(got, "qid").join(cited, "qid", "left")
        evidence = F.concat_ws(" ", F.array_join("trace", " "), "cited")
        return evaluate.report(rows.select("answer", "expected", "expected_entities", evidence.alias("evidence"), "tokens_used", F.lit(0.0).alias("latency_ms")))

    def delete(self) -> None:
        self.store.delete()
