"""Operations of a training-data pipeline: extraction, filters, deduplication,
mixing, scoring and tokenisation. Nothing else in the library imports this."""
