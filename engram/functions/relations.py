"""The vocabulary of relations, by how many targets a source may have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The relations an edge may have.  A property has one value, which replaces all before it; a
# multi-valued relation holds many targets at once; a single-valued one replaces its last target.
PROPERTIES = frozenset((
    "name alias nickname full_name title description age gender species nationality religion birthday blood_type height weight "
    "eye_color hair_color role occupation profession affiliation status email url home phone type genre format license version "
    "language difficulty priority deadline budget duration author accuracy throughput runtime latency size resolution capacity "
    "power_system universe timeline_position definition scope unit"
).split())
MULTI_VALUED = frozenset((
    "uses imports depends_on supports integrates_with calls returns references cites extends implements manufactured_by sold_by "
    "published_by produced_by distributed_by purchased_from contains features friend ally enemy colleague knows follows "
    "subscribes_to watches listens_to reads comments_on reacts_to reviews shares member_of partners_with competes_with "
    "contributes_to works_with collaborates_on co_authors edits moderates administers contributes_code_to funds sponsors endorses "
    "criticises owns writes maintains teaches enrolled_in attends participated_in participates_in competes_in volunteers_for tag "
    "category works_on founded_by created derived_from trained_on configured_with evaluated_on benchmarks_against defined_in "
    "located_in tested_by documents builds_on validates contradicts replicates extends_findings_of appears_in wields possesses "
    "mirrors foreshadows inspired_by derived_from_theory complements opposes exemplifies measures"
).split())
SINGLE_VALUED = frozenset((
    "part_of works_at reports_to managed_by assigned_to supervised_by supervises manages directs employs is_employed_by "
    "is_contracted_by is_ceo_of is_founder_of is_president_of represents acts_on_behalf_of is_delegated_by succeeds precedes "
    "replaces supersedes studies studies_at graduated_from is_educated_in mentor_of student_of taught released published "
    "acquired_by married_to is_engaged_to is_dating is_divorced_from is_separated_from parent_of child_of sibling_of lives_in "
    "born_in died_in is_based_in operates_in is_raised_in hosted_on deployed_to owned_by operated_by offers requires provides "
    "ranks set_in transforms_into instance_of subtype_of"
).split())


def normalised(relation: Column) -> Column:
    """Lower case, with underscores for what is no letter or digit."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(relation)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def cardinality(relation: Column) -> Column:
    """property, multi or single; null for a relation that the vocabulary lacks."""
    return F.when(relation.isin(*sorted(PROPERTIES)), "property").when(relation.isin(*sorted(MULTI_VALUED)), "multi").when(relation.isin(*sorted(SINGLE_VALUED)), "single")
