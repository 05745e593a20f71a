"""corepick.functions"""
