"""The same functions under the shapes that other matching libraries have."""
