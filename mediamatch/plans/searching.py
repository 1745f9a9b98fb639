"""Search as users call it: match, rank, hide what is not public, add titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mediamatch.functions.hashes import hash_to_long
from mediamatch.operators.features import DEFAULT_PROCESSORS
from mediamatch.operators.search import hydrate, prefilter_cap, public_only, search
from mediamatch.plans.bands import BandIndex
from mediamatch.plans.indexing import BROADCAST_IDS
from mediamatch.plans.probes import intake
from mediamatch.schema import SEARCH_LIMIT_DEFAULT, WIDGET_LIMIT_DEFAULT, WIDGET_LIMIT_MAX, Settings, clamp
from mediamatch.session import checkpointed


def _small(probes: DataFrame, bands: BandIndex, settings: Settings, lossless: bool) -> bool:
    hashes = probes.select(hash_to_long(F.lower("phash")).alias("bits")).where(F.col("bits").isNotNull()).distinct()
    return bands.pays(checkpointed(hashes), prefilter_cap(settings.match_threshold, lossless=lossless))


def reverse_search(
    probes: DataFrame,
    index: DataFrame,
    media: DataFrame,
    settings: Settings = Settings(),
    limit: int = SEARCH_LIMIT_DEFAULT,
    lossless: bool = False,
    bands: BandIndex | None = None,
    once: bool = False,
) -> DataFrame:
    """(probe_id, rank, attachment_id, score, title, url) for every probe.

    With `once` the search runs now and its ranked matches are written, so that reading the result does not search again.

    With `bands`, which must hold the hashes of the index, the index emits no keys and a small batch reads no features but
    those of its near rows. Pairs of a batch too large for that (`BandIndex.pays`) stay in the tasks that compare blocks.
    """
    near = bands.near if bands and _small(probes, bands, settings, lossless) else None
    ranked = search(probes, index, settings, limit, lossless=lossless, near=near)
    return hydrate(checkpointed(ranked) if once else ranked, media)


def public_search(
    probes: DataFrame,
    index: DataFrame,
    media: DataFrame,
    posts: DataFrame,
    settings: Settings = Settings(),
    limit: int = SEARCH_LIMIT_DEFAULT,
    filter_first: bool = False,
    signed_in: bool = False,
    once: bool = False,
) -> DataFrame:
    """Public form of the search, scores rounded to 4 places; `once` as in `reverse_search`.

    Where the settings open the search to signed-in visitors only, any other is refused with `PermissionError`.

    The limit is taken before hidden results are removed, so fewer than `limit` may remain;
    `filter_first` removes them before ranking instead.
    """
    if settings.search_visibility == "logged_in" and not signed_in:
        raise PermissionError("the search is open to signed-in visitors only")
    if filter_first:
        ranked = search(probes, index, settings, limit, keep=lambda found: public_only(found, media, posts))
        ranked = checkpointed(ranked) if once else ranked
    else:
        ranked = search(probes, index, settings, limit)
        ranked = public_only(checkpointed(ranked) if once else ranked, media, posts)
    return hydrate(ranked, media).withColumn("score", F.round("score", 4))


def search_uploads(
    uploads: DataFrame,
    index: DataFrame,
    media: DataFrame,
    settings: Settings = Settings(),
    limit: int = SEARCH_LIMIT_DEFAULT,
    chosen: DataFrame | None = None,
    most_ids: int = BROADCAST_IDS,
    **choices,
) -> DataFrame:
    """`reverse_search` for uploaded images (probe_id and what `intake` reads): refused and unreadable ones find nothing.

    Fingerprints of the probes are written once, as the search reads them several times. `chosen` (distinct probe_id)
    names the uploads to search for: up to `most_ids` of them pick images before these are read, beyond that all are
    fingerprinted and the small rows are picked. Pixels never go through a shuffle.
    """
    features = ["probe_id", *(p.name for p in DEFAULT_PROCESSORS)]
    picked = lambda rows: rows
    if chosen is not None:
        chosen = checkpointed(chosen.select("probe_id"))
        if chosen.count() <= most_ids:
            uploads = uploads.join(F.broadcast(chosen), "probe_id", "left_semi")
        else:
            picked = lambda rows: rows.join(chosen, "probe_id", "left_semi")
    taken = intake(uploads, settings).where(F.col("reject_reason").isNull()).select(*features)
    return reverse_search(checkpointed(picked(taken)), index, media, settings, limit, **choices)


def widget_limit(asked: int | None = None) -> int:
    return clamp(WIDGET_LIMIT_DEFAULT if asked is None else asked, 1, WIDGET_LIMIT_MAX)
