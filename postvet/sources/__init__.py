"""Reading submissions, pages and files; storing reports; test-table bindings."""
