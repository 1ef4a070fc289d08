"""All registered queries: name -> (function, SQL twin or None)."""

from catalog import indicators, modelling, newsflow, rates, stories, transcripts

ALL = {
    **transcripts.QUERIES, **rates.QUERIES, **newsflow.QUERIES, **indicators.QUERIES, **stories.QUERIES, **modelling.QUERIES,
}
