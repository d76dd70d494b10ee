"""Schemas of the tables that the stages exchange.

class_label   onto, iri, label          one row per class and label
edge          onto, child, parent       named classes only
posting       onto, token, iri, dtf     occurrences of a token in a class's labels
candidate     from_iri, to_iri, score, rank
mapping       src, tgt, score
set mapping   set_type, src, tgt, score set_type is src, tgt or combined
pair          a, b, kind                kind is synonym, soft or hard
label_pair    sent1, sent2, label       label is 1 for synonyms, 0 else
evaluation    set_type, threshold, n_mappings, n_ignored, p, r, f1
"""

MAPPING = "src string, tgt string, score double"
MAPPING_TSV = "Entity1 string, Entity2 string, Value double"

#: Namespaces and their short forms (fixed values).
NAMESPACES = {
    "http://bioontology.org/projects/ontologies/fma/fmaOwlDlComponent_2_0#": "fma:",
    "http://ncicb.nci.nih.gov/xml/owl/EVS/Thesaurus.owl#": "nci:",
    "http://www.ihtsdo.org/snomed#": "snomed:",
    "http://purl.obolibrary.org/obo/": "obo:",
    "http://www.orpha.net/ORDO/": "ordo:",
}

#: Class that stands above all others and is no class of its own.
ROOT = "http://www.w3.org/2002/07/owl#Thing"
