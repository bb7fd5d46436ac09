"""Stop-word lists.

The query list and the fallback are fixed values; the long index list is a
parameter (one word a line) given to ``load``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# The short fallback list.
FALLBACK = "a an and are as at be by for from has he in is it its of on that the this to was were will with".split()

# The query-side list.
QUERY = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves"
).split()

# Terms a query keeps though they are short or listed.
ALWAYS_KEPT = "vs war israel gaza iran us uk un eu".split()


def load(spark: SparkSession, path: str) -> list[str]:
    """A list of one word a line; blank lines are skipped."""
    return sorted({r[0].strip() for r in spark.read.text(path).collect() if r[0].strip()})
