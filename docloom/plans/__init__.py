"""Queries by name. Importing the package registers all of them."""

from docloom.plans import registry as registry  # isort: skip
from docloom.plans import documents as documents  # isort: skip
from docloom.plans import reports as reports  # isort: skip
from docloom.plans import links as links  # isort: skip
from docloom.plans import guards as guards  # isort: skip
from docloom.plans import profiles as profiles  # isort: skip
from docloom.plans import retrieval as retrieval  # isort: skip
from docloom.plans import synthesis as synthesis  # isort: skip
from docloom.plans import operations as operations  # isort: skip
from docloom.plans import catalogue as catalogue  # isort: skip
from docloom.plans import sources as sources  # isort: skip
from docloom.plans import training as training  # isort: skip
