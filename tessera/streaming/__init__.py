"""The core engine is batch only; its stages are stateless between runs. Keyed streaming state is used by the
training-data operators alone, in their own subpackage."""
