"""The song-chart plan: plays joined with songs, counted per window, ranked per genre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamtables.operators.joins import enrich
from streamtables.operators.ranking import top_k
from streamtables.operators.windows import tumble_count


def best_first() -> list[Column]:
    """Chart order: most plays first; equal counts are settled by the smaller song id."""
    return [F.col("play_count").desc(), F.col("song_id").asc(), F.col("name").asc()]


def long_plays(plays: DataFrame, min_duration: float) -> DataFrame:
    """Plays of a minimum duration. A missing duration does not qualify."""
    return plays.filter(F.col("duration") >= min_duration)


def song_plays(plays: DataFrame, songs: DataFrame, min_duration: float, salt: int = 1) -> DataFrame:
    """Plays with the attributes of their song, one row per matching song row."""
    joined = enrich(long_plays(plays, min_duration), songs, "song_id", "id", salt=salt)
    return joined.select("song_id", "album", "artist", "name", "genre", "duration", "event_time")


def window_counts(enriched: DataFrame, size: str) -> DataFrame:
    return tumble_count(enriched, "event_time", size, ["song_id", "name", "genre"])


def chart(enriched: DataFrame, size: str, k: int) -> DataFrame:
    """Top K songs per window and genre from enriched plays."""
    ranked = top_k(window_counts(enriched, size), ["window_start", "window_end", "genre"], best_first(), k)
    return ranked.select("window_start", "window_end", "song_id", "name", "genre", "play_count")


def chart_from_counts(counts: DataFrame, songs: DataFrame, k: int) -> DataFrame:
    """Top K songs per window and genre from play counts per window and song id.

    Several song rows with one id each receive the full count, as a join of single plays would
    give. The sum finds its rows already partitioned by song.
    """
    joined = enrich(counts, songs.select("id", "name", "genre"), "song_id", "id")
    totals = joined.groupBy("window_start", "window_end", "song_id", "name", "genre").agg(
        F.sum("plays").alias("play_count")
    )
    ranked = top_k(totals, ["window_start", "window_end", "genre"], best_first(), k)
    return ranked.select("window_start", "window_end", "song_id", "name", "genre", "play_count")


def chart_from_plays(plays: DataFrame, songs: DataFrame, min_duration: float, size: str, k: int) -> DataFrame:
    """The same chart in one plan, counting before the join.

    Plays shrink to one row per window and song inside the map tasks, so neither the join nor
    the ranking meets raw plays, and a song with a large share of all plays costs one row per
    window. On a stream the counts of closed windows go through ``chart_from_counts`` batch by
    batch.
    """
    counts = tumble_count(long_plays(plays, min_duration), "event_time", size, ["song_id"], "plays")
    return chart_from_counts(counts, songs, k)
