from pricemill.streaming.stateless import clean_stream, with_frequencies

__all__ = ["clean_stream", "with_frequencies"]
