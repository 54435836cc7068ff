"""Column functions that stand on their own."""

from papertide.operators.corpus import month_number, number_month
from papertide.operators.entities import inverted_index_to_text, phrases, tokens
from papertide.operators.providers import first_spellings
from papertide.operators.records import normalized_doi, title_key
from papertide.operators.windows import effective_source, scholarly_date
from papertide.sources.files import split_values

__all__ = ["effective_source", "first_spellings", "inverted_index_to_text", "month_number", "normalized_doi", "number_month", "phrases", "scholarly_date", "split_values", "title_key", "tokens"]
