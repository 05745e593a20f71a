"""corepick.operators"""
