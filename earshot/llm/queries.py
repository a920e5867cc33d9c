"""The registered queries of this subpackage, by name."""

from __future__ import annotations

from . import conversation_trie, url_filters, vector_codes
from .conversation_trie import op13_conversation_trie
from .decontamination import op10_simhash_decontamination
from .jpeg import op2_jpeg_media
from .language_id import op6_bayesian_language_id
from .licenses import op7_license_scan
from .ngram_join import op8_ngram_jaccard
from .packing import op5_vector_packing
from .quality import op9_nb_support_vectors
from .quotes import op4_quotation_threads
from .rans import op1_rans_ids
from .token_counts import op3_token_counts
from .url_filters import op11_url_filters
from .vector_codes import op12_vector_codes

QUERIES = {
    f.__name__: f
    for f in (
        op1_rans_ids,
        op2_jpeg_media,
        op3_token_counts,
        op4_quotation_threads,
        op5_vector_packing,
        op6_bayesian_language_id,
        op7_license_scan,
        op8_ngram_jaccard,
        op9_nb_support_vectors,
        op10_simhash_decontamination,
        op11_url_filters,
        op12_vector_codes,
        op13_conversation_trie,
    )
}

#: Queries that SQL expresses over whole tables in reasonable time; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op11_url_filters": url_filters.ORACLE, "op12_vector_codes": vector_codes.ORACLE, "op13_conversation_trie": conversation_trie.ORACLE}
