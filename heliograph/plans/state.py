"""Queries on state that is kept: an index under changes, a plan carried out in two runs, places filled in, spans that are kept."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heliograph.operators import geo, jobs, spans
from heliograph.operators import organize as O
from heliograph.operators.journal import Journal
from heliograph.plans import catalog
from heliograph.plans import proxies as P
from heliograph.plans.registry import query
from heliograph.sources.band_index import BandIndex, similar_indexed
from heliograph.storage import Scratch, shared_root

PAGE = "page AS (SELECT * FROM photos WHERE status = 'active' AND ((latitude IS NULL AND longitude IS NULL) OR (latitude IS NOT NULL AND city IS NULL)) AND id > 50 ORDER BY id LIMIT 1000)"


@query(
    "a24_backfill_places",
    f"WITH {P.PHOTOS}, {P.PLACES}, {PAGE}, spots AS (SELECT id, coalesce(latitude, id % 170 - 85)::DOUBLE AS latitude, coalesce(longitude, id % 350 - 175)::DOUBLE AS longitude FROM page WHERE latitude IS NOT NULL OR id % 3 = 0), "
    f"met AS (SELECT p.id, g.*, {catalog.KM} AS km FROM spots p, places g) SELECT p.id, p.latitude, p.longitude, b.city, b.region, b.country, round_even(b.km, 1)::FLOAT AS place_distance_km FROM spots p "
    "LEFT JOIN (SELECT id, arg_min({'city': city, 'region': region, 'country': country, 'km': km}, (km, city)) AS b FROM met WHERE km <= 1000 GROUP BY id) USING (id)",
)
def _(spark, d):
    p = P.photos(spark, d)
    found = p.where("id % 3 = 0").select("id", (F.col("id") % 170 - 85).cast("double").alias("latitude"), (F.col("id") % 350 - 175).cast("double").alias("longitude"))
    return geo.backfilled(p, found, P.places(spark, d), 50, 1000, 1000.0)


CHANGED = f"{P.HASHED}, now AS (SELECT * REPLACE (CASE WHEN id % 50 = 9 THEN xor(phash, 3::BIGINT) ELSE phash END AS phash) FROM hashed WHERE id % 50 <> 7)"


@query(
    "j15_indexed",
    f"WITH {CHANGED}, probe AS (SELECT arg_max(phash, (n, -i)) AS phash, arg_max(i, (n, -i)) AS i FROM (SELECT phash, count(*) AS n, min(id) AS i FROM now GROUP BY phash)) SELECT id, bit_count(xor(now.phash, probe.phash))::INT AS distance FROM now, probe WHERE status = 'active' AND id <> i AND bit_count(xor(now.phash, probe.phash)) <= 6 ORDER BY distance, id LIMIT 50",
)
def _(spark, d):
    """The photos nearest to one with many copies, from the stored index, after photos have gone and hashes have changed."""
    scratch = Scratch(spark, "j15")
    own = scratch.table(P.hashed_photos(spark, d).select("id", "phash", "status"), "photos")
    index = BandIndex(spark, f"{scratch.base}/index")
    index.build(own)
    changes = own.where("id % 50 IN (7, 9)").select("id", F.col("phash").alias("old_phash"), F.when(F.col("id") % 50 == 9, F.col("phash").bitwiseXOR(F.lit(3))).alias("new_phash"))
    index.merge(changes)
    now = own.join(changes.select("id", "new_phash"), "id", "left").where("id % 50 <> 7").select("id", F.coalesce("new_phash", "phash").alias("phash"))
    most = now.groupBy("phash").agg(F.count("*").alias("n"), F.min("id").alias("i")).agg(F.max(F.struct("n", -F.col("i"), "phash")).alias("m")).first()["m"]
    return similar_indexed(index, own, -most[1], most["phash"], limit=50).select("id", "distance")


@query("d17_resumed", f"WITH {catalog.NAMED} SELECT p.id, coalesce(dest, path) AS path FROM photos p LEFT JOIN named USING (id)")
def _(spark, d):
    """A plan carried out in batches of 100 by two runs, of which the first stops after its first job."""
    p = P.photos(spark, d)
    base = f"{shared_root(spark)}/heliograph/journal-{uuid.uuid4().hex}"
    journal = Journal(spark, base, size=100)
    journal.plan(O.planned_moves(catalog._plan(spark, d), p, catalog.SPEC))
    journal.run(p, together=20, stop_after=1)
    again = Journal(spark, base, size=100)
    again.run(p, together=20)
    return again.applied(p.select("id", "path")).select("id", "path")


SPANS = "spans AS (SELECT event_id AS span_id, CASE WHEN event_id % 6 <> 0 THEN event_id - event_id % 4 - 1 END AS parent_id, CASE event_id % 3 WHEN 0 THEN 'server' WHEN 1 THEN 'client' ELSE 'internal' END AS kind, CASE WHEN event_id % 9 = 0 THEN 'OPTIONS' ELSE 'GET' END AS method FROM events)"


@query(
    "d23_kept_spans",
    f"WITH RECURSIVE {SPANS}, good AS (SELECT * FROM spans WHERE NOT ((kind = 'server' AND method = 'OPTIONS') OR (kind = 'client' AND parent_id IS NULL))), "
    "kept AS (SELECT span_id FROM good WHERE parent_id IS NULL OR parent_id NOT IN (SELECT span_id FROM spans) UNION ALL SELECT g.span_id FROM kept k JOIN good g ON g.parent_id = k.span_id) SELECT span_id FROM kept",
)
def _(spark, d):
    own = P.read(spark, d, "events").select(F.col("event_id").alias("span_id"), F.expr("CASE WHEN event_id % 6 <> 0 THEN event_id - event_id % 4 - 1 END").alias("parent_id"), F.expr("CASE event_id % 3 WHEN 0 THEN 'server' WHEN 1 THEN 'client' ELSE 'internal' END").alias("kind"), F.expr("CASE WHEN event_id % 9 = 0 THEN 'OPTIONS' ELSE 'GET' END").alias("method"))
    return spans.kept_spans(own).select("span_id")


STORED = "stored AS (SELECT DISTINCT CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 END AS id, '/lib/' || lang AS path, lang <> 'es' AS enabled FROM documents)"


def stored_roots(spark, d):
    """A scan root for every language of ``documents``; that of Spanish is not enabled."""
    lang = P.read(spark, d, "documents").select("lang").distinct()
    number = F.expr("CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 END")
    return lang.select(number.alias("id"), F.concat(F.lit("/lib/"), "lang").alias("path"), (F.col("lang") != "es").alias("enabled"))


@query("f14_scan_roots", f"WITH {STORED} SELECT id, path FROM stored WHERE id IN (2, 4)")
def _(spark, d):
    return jobs.roots_of(stored_roots(spark, d), [2, 4]).select("id", "path")


@query("f14_enabled_roots", f"WITH {STORED} SELECT id, path FROM stored WHERE enabled")
def _(spark, d):
    return jobs.roots_of(stored_roots(spark, d), None).select("id", "path")


@query("d18_add_root", f"WITH {STORED} SELECT id, path, enabled FROM stored UNION ALL SELECT max(id) + 1, '/lib/it', true FROM stored")
def _(spark, d):
    return jobs.add_root(stored_roots(spark, d), "/lib/it/")
