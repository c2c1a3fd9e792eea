"""File sources, encoding resolution, and sinks."""
